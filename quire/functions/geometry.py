"""Quads and page regions in array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST_AREA = 100.0
SPREAD_ASPECT = 1.15
TARGET_DENSITY = 0.07
REGIONS_MOST = 8


def area(quad: Column) -> Column:
    """Shoelace area of an array of points [x, y]."""
    turned = F.concat(F.slice(quad, F.lit(2), F.size(quad) - 1), F.slice(quad, F.lit(1), F.lit(1)))
    cross = F.zip_with(quad, turned, lambda a, b: a[0] * b[1] - b[0] * a[1])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, x: s + x)) / 2


def valid(quad: Column, width: Column, height: Column) -> Column:
    """Four finite points that span an area, none more than a width to the left of or above the page or beyond twice its longer side."""
    most = 2 * F.greatest(width, height)
    # not a number compares as the largest
    inside = F.forall(quad, lambda p: (F.size(p) == 2) & F.forall(p, lambda x: (x >= -width) & (x <= most)))
    return F.coalesce((F.size(quad) == 4) & inside & (area(quad) >= LEAST_AREA), F.lit(False))


def valid_page(quads: Column, width: Column, height: Column) -> Column:
    """One to REGIONS_MOST valid regions."""
    return F.coalesce(F.size(quads).between(1, REGIONS_MOST) & F.forall(quads, lambda q: valid(q, width, height)), F.lit(False))


def side_length(quad: Column, i: int, j: int) -> Column:
    return F.hypot(quad[i][0] - quad[j][0], quad[i][1] - quad[j][1])


def aspect(quad: Column) -> Column:
    """Mean width over mean height of a quad in the order top left, top right, bottom right, bottom left."""
    return (side_length(quad, 0, 1) + side_length(quad, 3, 2)) / (side_length(quad, 0, 3) + side_length(quad, 1, 2))


def is_spread(quad: Column) -> Column:
    return aspect(quad) > SPREAD_ASPECT


def ordered(quad: Column) -> Column:
    """Four points as top left, top right, bottom right, bottom left: least and most sum, least and most difference y - x."""
    by = lambda key: F.array_sort(F.transform(quad, lambda p: F.struct(key(p).alias("k"), p.alias("p"))))
    total, slope = by(lambda p: p[0] + p[1]), by(lambda p: p[1] - p[0])
    return F.array(total[0]["p"], slope[0]["p"], total[3]["p"], slope[3]["p"])


def scaled(quad: Column, s: Column) -> Column:
    return F.transform(quad, lambda p: F.transform(p, lambda x: x * s))


def ink_margin(width: Column, height: Column, ink: Column, density: float = TARGET_DENSITY, least: int = 4, most: int = 60) -> Column:
    """Margin m on all sides for which ink / ((w + 2m)(h + 2m)) comes to density, held to least..most."""
    b = (width + height).cast("double")
    c = width * height - ink / F.lit(density)
    m = (-b + F.sqrt(F.greatest(b * b - 4 * c, F.lit(0.0)))) / 4
    return F.greatest(F.lit(least), F.least(F.lit(most), F.floor(m).cast("int")))


def sides(n: Column) -> Column:
    """Side letters of n crops: P; L, R; A, B, C and on."""
    letters = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.char(F.lit(65) + i))
    return F.when(n == 1, F.array(F.lit("P"))).when(n == 2, F.array(F.lit("L"), F.lit("R"))).otherwise(letters)
