"""Line deduplication by a segment-partition edit join.

Lines that are within ``EDITS`` edits of each other share a segment: a line is cut into ``EDITS + 1`` even
segments, and at least one of them is left whole by that many edits.  Every distinct line indexes its own
segments by (length, segment number, segment) and probes the substrings that may match segments of lines of
its length or up to ``EDITS`` shorter; the starting places are those that leave edits enough for the
segments on either side.  Candidates are verified by a banded bit-parallel edit distance: the band's
2 * EDITS + 1 diagonals are the bits of an integer.  Links between distinct lines make classes (connected
components); equal lines are one node from the start and are never listed as pairs.  DataFrame and SQL
functions only.

A segment that more than ``HOT_KEY`` lines index would give pairs by the square.  For one edit, lines under such
a segment are cut further (`_refined`): into ``PARTS`` segments, of which all but one are whole, and lines that
agree in all of these are cut again within the one that is left, until it has at most ``STRETCH`` characters.
Each level reads a line's characters ``PARTS`` times and drops segments that no other line shares.
In what is left, lines that agree but for the character at one place are all within one edit: a star names them
and its size counts them, so nothing is listed by the square.  A line that equals another one less a character is
found by that equality.  Stars' and other links are verified like all candidates; pairs of such lines are left out
of the first way, so every link is counted once.  With more edits hot segments are not cut further.

Lines are the parts of a text between line feeds; those without a word take no part and always stay.  Lines of fewer
than ``MIN_CHARS`` code points are compared by equality only.  A class is named by its first occurrence, the one with
the smallest (document, row, line number); the others are duplicates.

Defined results for odd input: null and empty texts have no lines that take part; repeated lines in one text
are occurrences like any other; rows are told apart by a row key, so rows with equal or null ids have lines of
their own; a null id comes first; very long lines are lines like any other; columns of the input keep their
names and values; an empty table gives an empty table.  Equality of lines is judged by 128 bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_CLASS, Scratch, components, table, unused, with_row_key, written

EDITS = 1
MIN_CHARS = 20
#: Lines that may index one segment before they are compared in the linear way.
HOT_KEY = 50
STRETCH = 24
PARTS = 16


def _segments(length: str, edits: int) -> list[tuple[str, str]]:
    """(start from 0, length) of the segments of a line of that length, as SQL; the last ones take what is over."""
    parts = edits + 1
    short = f"({length} div {parts})"
    over = f"({length} % {parts})"
    out = []
    for i in range(parts):
        before = f"greatest({i} - ({parts} - {over}), 0)"
        out.append((f"({i} * {short} + {before})", f"({short} + CASE WHEN {i} >= {parts} - {over} THEN 1 ELSE 0 END)"))
    return out


def index_keys(line: str, length: str, edits: int) -> list[str]:
    """SQL of the keys under which a line is indexed."""
    return [f"xxhash64({length}, {i}, substring({line}, CAST({at} + 1 AS int), CAST({n} AS int)))" for i, (at, n) in enumerate(_segments(length, edits))]


def probe_keys(line: str, length: str, edits: int) -> list[str]:
    """SQL of the keys that a line looks up: lines of its length, and shorter by up to ``edits``."""
    out = []
    for less in range(edits + 1):
        other = f"({length} - {less})"
        for i, (at, n) in enumerate(_segments(other, edits)):
            lowest = max(-i, less - (edits - i))
            highest = min(i, less + (edits - i))
            out += [f"xxhash64({other}, {i}, substring({line}, CAST({at} + 1 + {shift} AS int), CAST({n} AS int)))" for shift in range(lowest, highest + 1)]
    return out


def distance_within(a: str, b: str, edits: int) -> str:
    """SQL, true if two strings of at least 2 * edits characters are within that many edits; ``a`` is not the shorter one."""
    width = 2 * edits + 1
    full = (1 << width) - 1
    pattern, text = f"split({a}, '')", f"split({b}, '')"
    # Bit w of column j is row j - edits + w of the pattern.
    hits = " + ".join(f"(CASE WHEN get(p.a, j - {edits} + {w}) = c THEN {1 << w} ELSE 0 END)" for w in range(width))
    d0 = "((((h & s.vp) + s.vp) ^ s.vp) | h | s.vn)"
    step = (
        f"transform(array({d0} & {full}), d -> transform(array((s.vn | ~(d | s.vp)) & {full}), hp -> named_struct("
        f"'j', s.j + 1, "
        f"'vp', ((d & s.vp) | ~(shiftright(d, 1) | hp)) & {full}, "
        f"'vn', shiftright(d, 1) & hp, "
        f"'n', s.n + CASE WHEN s.j < s.m - {edits} THEN CASE WHEN d & {1 << (width - 1)} = 0 THEN 1 ELSE 0 END "
        f"ELSE CASE WHEN hp & s.low <> 0 THEN 1 WHEN d & s.vp & s.low <> 0 THEN -1 ELSE 0 END END, "
        f"'low', CASE WHEN s.j < s.m - {edits} THEN s.low ELSE shiftright(s.low, 1) END, "
        f"'m', s.m))[0])[0]"
    )
    start = f"named_struct('j', 0, 'vp', {(full << edits) & full}, 'vn', 0, 'n', {edits}, 'low', {1 << (width - 2)}, 'm', size(p.a))"
    return (
        f"abs(length({a}) - length({b})) <= {edits} AND transform(array(named_struct('a', {pattern}, 'b', {text})), p -> "
        f"aggregate(transform(p.b, (c, j) -> {hits}), {start}, (s, h) -> {step}, s -> s.n <= {edits}))[0]"
    )


def lines_of(df: DataFrame, doc: str, text: str, row_key: str) -> DataFrame:
    """``doc_id, row_key, line_no, line`` of the lines that take part."""
    text = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    out = df.select(F.col(f"`{doc}`").alias("doc_id"), F.col(f"`{row_key}`").alias("row_key"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return out.where(F.col("line").rlike(WORD_CLASS))


def _verified(s: Scratch, pairs: DataFrame, lines: DataFrame, edits: int) -> DataFrame:
    """The pairs (a, b) of nodes whose lines are within the edits."""
    # The lines of candidates are taken out once; merge joins at every size, because what is joined grows with the input.
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    needed = s.written(lines.select("node", "line").join(wanted.hint("merge"), "node"), "candidate-lines")
    one = needed.select(F.col("node").alias("a"), F.col("line").alias("line_a"))
    two = needed.select(F.col("node").alias("b"), F.col("line").alias("line_b"))
    texts = pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b")
    longer = F.length("line_a") >= F.length("line_b")
    texts = texts.select("a", "b", F.when(longer, F.col("line_a")).otherwise(F.col("line_b")).alias("x"), F.when(longer, F.col("line_b")).otherwise(F.col("line_a")).alias("y"))
    return s.written(texts.where(F.expr(distance_within("x", "y", edits))).select("a", "b"), "line-links")


def line_links(s: Scratch, distinct: DataFrame, edits: int = EDITS, hot_key: int = HOT_KEY) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) that connect the nodes of distinct lines (node, line) as they should be, and ``node, n_links``."""
    sized = distinct.withColumn("n", F.length("line"))
    left = sized.select(F.col("node").alias("a"), F.explode(F.expr(f"array({', '.join(probe_keys('line', 'n', edits))})")).alias("key"))
    right = sized.select(F.col("node").alias("b"), F.explode(F.expr(f"array({', '.join(index_keys('line', 'n', edits))})")).alias("key"))
    if edits == 1:
        hot = s.written(right.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot_key).select("key"), "hot-keys")
        hot_nodes = left.join(hot, "key", "left_semi").select(F.col("a").alias("node")).union(right.join(hot, "key", "left_semi").select("b"))
        hot_nodes = s.written(hot_nodes.distinct(), "hot-lines")
        left, right = left.join(hot, "key", "left_anti"), right.join(hot, "key", "left_anti")
    met = left.join(right, "key").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    if edits == 1:
        in_a, in_b = hot_nodes.select(F.col("node").alias("a"), F.lit(True).alias("hot_a")), hot_nodes.select(F.col("node").alias("b"), F.lit(True).alias("hot_b"))
        met = met.join(in_a, "a", "left").join(in_b, "b", "left").where("NOT (coalesce(hot_a, false) AND coalesce(hot_b, false))").select("a", "b")
    pairs = s.written(met, "line-pairs")
    s.drop()
    links = _verified(s, pairs, distinct, edits)
    one = F.lit(1).cast("long")
    degrees = links.select(F.col("a").alias("node"), one.alias("k")).union(links.select("b", one))
    if edits == 1:
        more, counted = _refined(s, s.written(distinct.select("node", "line").join(hot_nodes, "node", "left_semi"), "hot-texts"))
        links, degrees = links.union(more), degrees.union(counted)
    return links, degrees.groupBy("node").agg(F.sum("k").alias("n_links"))


def _refined(s: Scratch, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stars (a, b) and counts (node, k) of all links by one edit among lines (node, line); linear in the lines."""
    # Role 0: the line as it is; role 1: one character longer than what it is compared with.  m is the shorter one's length.
    roles = lines.select("node", F.explode(F.array(F.lit(0), F.lit(1))).alias("role"), F.col("line").alias("inner"))
    rows = roles.withColumn("m", F.length("inner") - F.col("role")).select("node", "role", "m", "inner", F.xxhash64("m").alias("key"))
    segments = _segments("m", PARTS - 1)
    cuts = ", ".join(
        f"named_struct('key', xxhash64(key, {i}, left(inner, CAST({at} AS int)), substring(inner, CAST({at} + {n} + role + 1 AS int))), "
        f"'inner', substring(inner, CAST({at} + 1 AS int), CAST({n} + role AS int)), 'm', CAST({n} AS int))"
        for i, (at, n) in enumerate(segments)
    )
    while True:
        several = rows.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("key")
        rows = s.written(rows.join(several, "key").select("node", "role", "m", "inner", "key"), "refined")
        if rows.where(F.col("m") > STRETCH).isEmpty():
            break
        cut = rows.where(F.col("m") > STRETCH).select("node", "role", F.explode(F.expr(f"array({cuts})")).alias("x")).select("node", "role", "x.m", "x.inner", "x.key")
        rows = s.written(cut.union(rows.where(F.col("m") <= STRETCH)), "refined-cuts")
    places = F.sequence(F.lit(1), F.length("inner"))
    without = "concat(left(inner, p - 1), substring(inner, p + 1))"
    some = rows.where(F.length("inner") > 0)
    # One character replaced: lines that agree without the character at one place.
    same = some.where("role = 0").select("node", "key", "inner", F.explode(places).alias("p")).select("node", F.expr(f"xxhash64(key, p, length(inner), {without})").alias("key"))
    same = s.written(same, "replaced")
    stars = same.groupBy("key").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1")
    starred = s.written(same.join(stars, "key").select(F.col("node").alias("a"), "b", (F.col("n") - 1).alias("k")), "replaced-links")
    # One character more: the longer line without it is the shorter one.
    longer = some.where("role = 1").select("node", "key", "inner", F.explode(places).alias("p")).select(F.col("node").alias("a"), F.expr(f"xxhash64(key, {without})").alias("key"))
    shorter = rows.where("role = 0").select(F.col("node").alias("b"), F.xxhash64("key", "inner").alias("key"))
    added = _verified(s, s.written(longer.join(shorter, "key").where("a <> b").select("a", "b").distinct(), "added-pairs"), lines, 1)
    named = _verified(s, s.written(starred.where("a <> b").select("a", "b").distinct(), "star-pairs"), lines, 1)
    one = F.lit(1).cast("long")
    return named.union(added), starred.select(F.col("a").alias("node"), "k").union(added.select("a", one)).union(added.select("b", one))


def line_classes(df: DataFrame, doc: str = "doc_id", text: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS, hot_key: int = HOT_KEY, row_key: str | None = None) -> DataFrame:
    """``doc_id, row_key, line_no, class_doc, class_row, class_line, n_links, duplicate`` of every line that takes part.

    A class is named by its first occurrence; ``n_links`` is the number of other distinct lines within the
    edits.  ``row_key`` names a column that tells rows apart, if there is one.
    """
    if min_chars < 2 * edits + 1:
        raise ValueError("lines have to be longer than the band is wide")
    with Scratch(df.sparkSession) as s:
        if row_key is None:
            (row_key,) = unused(df, "row_key")
            df = s.written(df.select(F.col(f"`{doc}`"), F.col(f"`{text}`")).withColumn(row_key, F.monotonically_increasing_id()), "keyed")
        lines = lines_of(df, doc, text, row_key)
        digest = [F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")]
        distinct = lines.groupBy("line").agg(F.count("*").alias("times")).select(F.monotonically_increasing_id().alias("node"), "times", *digest, "line")
        distinct = s.written(distinct, "distinct-lines")
        s.drop()
        links, degree = line_links(s, distinct.where(F.length("line") >= min_chars).select("node", "line"), edits, hot_key)
        linked = components(links).join(degree, "node")
        shared = distinct.select("node", "times", "h1", "h2").join(linked, "node", "left").where("times > 1 OR label IS NOT NULL")
        shared = s.written(shared.select("h1", "h2", F.coalesce("label", "node").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "shared-lines")
        occurrences = lines.select("doc_id", "row_key", "line_no", *digest)
        known = s.written(occurrences.join(shared, ["h1", "h2"], "left").drop("h1", "h2"), "occurrences")
        # Lines of no class need no second join, so they do not meet under a null key.
        place = F.struct("doc_id", "row_key", "line_no")
        several = known.where("class_id IS NOT NULL")
        first = s.written(several.groupBy("class_id").agg(F.min(place).alias("first")), "first-lines")
        stays = (F.col("row_key") == F.col("first.row_key")) & (F.col("line_no") == F.col("first.line_no"))
        columns = ["doc_id", "row_key", "line_no"]
        with_class = several.join(first, "class_id").select(
            *columns, F.col("first.doc_id").alias("class_doc"), F.col("first.row_key").alias("class_row"), F.col("first.line_no").alias("class_line"), "n_links", (~stays).alias("duplicate")
        )
        alone = known.where("class_id IS NULL").select(
            *columns, F.col("doc_id").alias("class_doc"), F.col("row_key").alias("class_row"), F.col("line_no").alias("class_line"), F.lit(0).cast("long").alias("n_links"), F.lit(False).alias("duplicate")
        )
        return written(with_class.union(alone), "line-classes")


def without_duplicate_lines(df: DataFrame, doc: str = "doc_id", text: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``df`` with duplicate lines of ``min_chars`` or more cut out of the texts; documents left without a word by that are gone."""
    names = df.columns
    (row_key,) = unused(df, "row_key")
    keyed = with_row_key(df, row_key)
    classes = line_classes(keyed, doc, text, edits, min_chars, row_key=row_key)
    rows = keyed.select(F.col(f"`{row_key}`").alias("row_key"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.split(F.col(f"`{text}`").cast("string"), "\n").alias("lines"))
    # Short lines stay: their number is looked up in the text itself.
    cut = classes.where("duplicate").groupBy("row_key").agg(F.collect_list("line_no").alias("cut"))
    joined = rows.join(cut, "row_key", "left")
    stays = f"array_except(sequence(0, size(lines) - 1), filter(cut, i -> length(lines[i]) >= {min_chars}))"
    left = F.expr(f"CASE WHEN cut IS NULL THEN row.`{text}` ELSE array_join(transform({stays}, i -> lines[i]), '\n') END")
    out = joined.withColumn("left_text", left)
    out = out.where(F.col("cut").isNull() | F.col("left_text").rlike(WORD_CLASS))
    return out.select(*[F.col("left_text").alias(c) if c == text else F.col("row")[c].alias(c) for c in names])


def op7_segment_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = line_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return classes.select("doc_id", "line_no", "class_doc", "class_line", "n_links", "duplicate")
