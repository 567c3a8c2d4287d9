"""Ink, colour-space and colour-difference expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: D65 white point of sRGB and the limits of the Lab cube root (fixed values of the standards).
WHITE = (0.95047, 1.0, 1.08883)
EPSILON, KAPPA = 216 / 24389, 24389 / 27


def coverage(*inks: Column) -> Column:
    """Total area coverage in percent."""
    total = inks[0]
    for ink in inks[1:]:
        total = total + ink
    return total * 100


def is_registration(*inks: Column) -> Column:
    """Every ink at 99 % or more."""
    test = inks[0] >= 0.99
    for ink in inks[1:]:
        test = test & (ink >= 0.99)
    return test


def active_inks(*inks: Column, over: float = 0.0) -> Column:
    total = F.lit(0)
    for ink in inks:
        total = total + F.when(ink > over, 1).otherwise(0)
    return total


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> tuple[Column, Column, Column]:
    return tuple((1 - x) * (1 - k) for x in (c, m, y))


def linear(v: Column) -> Column:
    """sRGB component to linear light."""
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def luminance(r: Column, g: Column, b: Column) -> Column:
    """Relative luminance."""
    return 0.2126 * linear(r) + 0.7152 * linear(g) + 0.0722 * linear(b)


def contrast(one: Column, two: Column) -> Column:
    """Contrast ratio of two luminances."""
    return (F.greatest(one, two) + 0.05) / (F.least(one, two) + 0.05)


def rgb_to_lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    r, g, b = linear(r), linear(g), linear(b)
    x = (0.4124564 * r + 0.3575761 * g + 0.1804375 * b) / WHITE[0]
    y = (0.2126729 * r + 0.7151522 * g + 0.0721750 * b) / WHITE[1]
    z = (0.0193339 * r + 0.1191920 * g + 0.9503041 * b) / WHITE[2]
    f = [F.when(t > EPSILON, F.cbrt(t)).otherwise((KAPPA * t + 16) / 116) for t in (x, y, z)]
    return 116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])


def delta_e76(one: tuple, two: tuple) -> Column:
    return F.sqrt(sum(((p - q) * (p - q) for p, q in zip(one, two, strict=True)), F.lit(0.0)))


def delta_e94(one: tuple, two: tuple, textile: bool = False) -> Column:
    kl, k1, k2 = (2.0, 0.048, 0.014) if textile else (1.0, 0.045, 0.015)
    c1, c2 = F.hypot(one[1], one[2]), F.hypot(two[1], two[2])
    dl, dc = one[0] - two[0], c1 - c2
    dh2 = F.greatest((one[1] - two[1]) ** 2 + (one[2] - two[2]) ** 2 - dc * dc, F.lit(0.0))
    return F.sqrt((dl / kl) ** 2 + (dc / (1 + k1 * c1)) ** 2 + dh2 / (1 + k2 * c1) ** 2)


def delta_e2000(one: tuple, two: tuple) -> Column:
    """CIEDE2000 with unit weights."""
    (l1, a1, b1), (l2, a2, b2) = one, two
    mean = (F.hypot(a1, b1) + F.hypot(a2, b2)) / 2
    g = 0.5 * (1 - F.sqrt(mean**7 / (mean**7 + 25.0**7)))
    a1, a2 = a1 * (1 + g), a2 * (1 + g)
    c1, c2 = F.hypot(a1, b1), F.hypot(a2, b2)
    h1, h2 = (F.when((a == 0) & (b == 0), 0.0).otherwise(F.pmod(F.degrees(F.atan2(b, a)), F.lit(360.0))) for a, b in ((a1, b1), (a2, b2)))
    grey = c1 * c2 == 0
    turn = h2 - h1
    dh = F.when(grey, 0.0).when(F.abs(turn) <= 180, turn).when(turn > 180, turn - 360).otherwise(turn + 360)
    dl, dc = l2 - l1, c2 - c1
    dh = 2 * F.sqrt(c1 * c2) * F.sin(F.radians(dh / 2))
    lm, cm, hs = (l1 + l2) / 2, (c1 + c2) / 2, h1 + h2
    hm = F.when(grey, hs).when(F.abs(h1 - h2) <= 180, hs / 2).when(hs < 360, (hs + 360) / 2).otherwise((hs - 360) / 2)
    t = 1 - 0.17 * F.cos(F.radians(hm - 30)) + 0.24 * F.cos(F.radians(2 * hm)) + 0.32 * F.cos(F.radians(3 * hm + 6)) - 0.20 * F.cos(F.radians(4 * hm - 63))
    sl = 1 + 0.015 * (lm - 50) ** 2 / F.sqrt(20 + (lm - 50) ** 2)
    sc, sh = 1 + 0.045 * cm, 1 + 0.015 * cm * t
    rc = 2 * F.sqrt(cm**7 / (cm**7 + 25.0**7))
    rt = -F.sin(F.radians(60 * F.exp(-(((hm - 275) / 25) ** 2)))) * rc
    return F.sqrt((dl / sl) ** 2 + (dc / sc) ** 2 + (dh / sh) ** 2 + rt * (dc / sc) * (dh / sh))


def out_of_gamut(lab: tuple, planes: list[tuple[float, float, float, float]]) -> Column:
    """Greatest violation of the half-spaces p . (L, a, b, 1) <= 0; in gamut up to 1e-6."""
    return F.greatest(*[p[0] * lab[0] + p[1] * lab[1] + p[2] * lab[2] + p[3] for p in planes], F.lit(-1e300))
