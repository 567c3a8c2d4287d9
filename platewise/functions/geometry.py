"""Matrices, boxes and page sizes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A matrix whose scale is below this draws nothing.
DEGENERATE = 1e-10


def rounded(value: Column, digits: int) -> Column:
    """A double rounded half away from zero as it is stored, not as its shortest decimal is written: 1.005 is a little less and gives 1.0."""
    scale = 10.0**digits
    return F.round(value * scale) / scale


def scale_x(a: Column, c: Column) -> Column:
    return F.sqrt(a * a + c * c)


def scale_y(b: Column, d: Column) -> Column:
    return F.sqrt(b * b + d * d)


def effective_dpi(width: Column, height: Column, a: Column, b: Column, c: Column, d: Column) -> Column:
    """Least resolution of the two axes at 72 points an inch; null for a degenerate matrix."""
    sx, sy = scale_x(a, c), scale_y(b, d)
    return F.when((sx >= DEGENERATE) & (sy >= DEGENERATE), F.least(width / (sx / 72.0), height / (sy / 72.0)))


def determinant(a: Column, b: Column, c: Column, d: Column) -> Column:
    return a * d - b * c


def shear(a: Column, b: Column, c: Column, d: Column) -> Column:
    """|ab + cd| / |det|; null for a degenerate matrix."""
    det = F.abs(determinant(a, b, c, d))
    return F.when(det >= DEGENERATE, F.abs(a * b + c * d) / det)


def off_right_angle(a: Column, b: Column) -> Column:
    """Degrees to the nearest multiple of 90."""
    turn = F.pmod(F.degrees(F.atan2(b, a)), F.lit(90.0))
    return F.least(turn, 90.0 - turn)


def is_mirrored(a: Column, b: Column, c: Column, d: Column) -> Column:
    return determinant(a, b, c, d) < 0


def product(m: dict[str, Column], n: dict[str, Column]) -> dict[str, Column]:
    """m x n for matrices given as columns a..f (row vectors are multiplied from the left)."""
    return {
        "a": m["a"] * n["a"] + m["b"] * n["c"],
        "b": m["a"] * n["b"] + m["b"] * n["d"],
        "c": m["c"] * n["a"] + m["d"] * n["c"],
        "d": m["c"] * n["b"] + m["d"] * n["d"],
        "e": m["e"] * n["a"] + m["f"] * n["c"] + n["e"],
        "f": m["e"] * n["b"] + m["f"] * n["d"] + n["f"],
    }


class Box:
    """Corner columns of a box, with the algebra of boxes."""

    def __init__(self, x0: Column, y0: Column, x1: Column, y1: Column):
        self.x0, self.y0, self.x1, self.y1 = x0, y0, x1, y1

    @classmethod
    def of(cls, prefix: str) -> Box:
        return cls(*(F.col(f"{prefix}{k}") for k in ("x0", "y0", "x1", "y1")))

    @property
    def width(self) -> Column:
        return self.x1 - self.x0

    @property
    def height(self) -> Column:
        return self.y1 - self.y0

    @property
    def area(self) -> Column:
        return F.greatest(self.width, F.lit(0.0)) * F.greatest(self.height, F.lit(0.0))

    def meet(self, other: Box) -> Box:
        return Box(F.greatest(self.x0, other.x0), F.greatest(self.y0, other.y0), F.least(self.x1, other.x1), F.least(self.y1, other.y1))

    def hull(self, other: Box) -> Box:
        return Box(F.least(self.x0, other.x0), F.least(self.y0, other.y0), F.greatest(self.x1, other.x1), F.greatest(self.y1, other.y1))

    def overlaps(self, other: Box) -> Column:
        return (self.x0 < other.x1) & (other.x0 < self.x1) & (self.y0 < other.y1) & (other.y0 < self.y1)

    def contains(self, other: Box, slack: float = 0.0) -> Column:
        return (other.x0 >= self.x0 - slack) & (other.y0 >= self.y0 - slack) & (other.x1 <= self.x1 + slack) & (other.y1 <= self.y1 + slack)

    def grown(self, by: float) -> Box:
        return Box(self.x0 - by, self.y0 - by, self.x1 + by, self.y1 + by)

    def overhang(self, inner: Box) -> Column:
        """How far ``inner`` sticks out beyond this box, on its worst side."""
        return F.greatest(self.x0 - inner.x0, self.y0 - inner.y0, inner.x1 - self.x1, inner.y1 - self.y1, F.lit(0.0))

    def gap(self, other: Box) -> Column:
        dx, dy = F.greatest(self.x0 - other.x1, other.x0 - self.x1, F.lit(0.0)), F.greatest(self.y0 - other.y1, other.y0 - self.y1, F.lit(0.0))
        return F.hypot(dx, dy)

    def iou(self, other: Box, slack: float = 0.5) -> Column:
        """Intersection over union; 1 if one box contains the other up to the slack."""
        both = self.meet(other).area
        inside = self.contains(other, slack) | other.contains(self, slack)
        return F.when(inside, 1.0).otherwise(both / (self.area + other.area - both))


def in_safety_band(content: Box, trim: Box, margin: float) -> Column:
    """Content touches one of the four strips of the given width inside the trim box."""
    return content.overlaps(trim) & ~Box(trim.x0 + margin, trim.y0 + margin, trim.x1 - margin, trim.y1 - margin).contains(content)


def size_mm(points: Column, user_unit: float = 1.0) -> Column:
    return points * user_unit * 25.4 / 72.0
