"""Operations of a training-data pipeline: scoring, formatting, deduplication, packing, search, rules,
sharding, web archives and mixing.  Nothing else in the library imports this subpackage."""
