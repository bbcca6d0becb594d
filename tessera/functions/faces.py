"""Where an aligned face lies in its picture: arithmetic on landmarks, no model.

The crop is the square that published portrait sets use: its axis runs from eye to eye, turned half by the line
from the eyes to the mouth; its half side is twice the distance of the eyes or 1.8 times that to the mouth,
whichever is longer; its centre lies a tenth of the way from the eyes to the mouth.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Landmarks of the left eye, the right eye and the corners of the mouth, by the number of landmarks.
MESH = (
    [33, 7, 163, 144, 145, 153, 154, 155, 133, 246, 161, 160, 159, 158, 157, 173],
    [263, 249, 390, 373, 374, 380, 381, 382, 362, 466, 388, 387, 386, 385, 384, 398],
    [61, 291],
)
CONTOUR = (range(36, 42), range(42, 48), [48, 54])
PARTS = {468: MESH, 478: MESH, 68: CONTOUR}


def face_quad(points: np.ndarray) -> np.ndarray:
    """Corners of the square: upper left, lower left, lower right, upper right of the upright face."""
    if len(points) not in PARTS:
        raise ValueError(f"not a set of landmarks: {len(points)} points")
    left, right, mouth = (complex(*np.asarray(points, float)[list(p)].mean(0)) for p in PARTS[len(points)])
    # Points are complex numbers, so that a quarter turn is a factor of 1j.
    eyes = (left + right) / 2
    across, down = right - left, mouth - eyes
    along = across - 1j * down
    along *= max(2.0 * abs(across), 1.8 * abs(down)) / abs(along)
    centre, side = eyes + 0.1 * down, 1j * along
    corners = [centre - along - side, centre - along + side, centre + along + side, centre + along - side]
    return np.array([[c.real, c.imag] for c in corners])


def face_size(quad: np.ndarray, max_size: int | None = None) -> int:
    """Side of the aligned picture: that of the square, cut to whole pixels, and no more than asked for."""
    natural = int(np.hypot(*(quad[3] - quad[0])))
    return natural if max_size is None else min(natural, max_size)


def is_partial(quad: np.ndarray, width: int, height: int) -> bool:
    """Whether the square leaves the picture."""
    low, high = np.floor(quad.min(0)), np.ceil(quad.max(0))
    return bool(low.min() < 0 or high[0] > width or high[1] > height)


@F.pandas_udf(T.StructType([T.StructField("quad", T.ArrayType(T.DoubleType())), T.StructField("size", T.IntegerType())]))
def align(landmarks: pd.Series) -> pd.DataFrame:
    """The corners (x and y in turn) and natural side for a column of landmarks (array of x, y pairs); null where their number is none known."""
    rows = []
    for points in landmarks:
        if points is None or len(points) not in PARTS:
            rows.append((None, None))
            continue
        quad = face_quad(np.array([list(p) for p in points], float))
        rows.append((quad.ravel().tolist(), face_size(quad)))
    return pd.DataFrame(rows, columns=["quad", "size"]).astype({"size": "Int32"})
