"""Boxes on a page, as [x, y, width, height] columns, and captions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.grouped import map_groups


# Which detection of one region is kept.
SOURCE_RANK = {"table": 3, "image": 2, "drawing": 1, "merged": 0}


def _side(box: Column, i: int) -> tuple[Column, Column]:
    return box[i], box[i] + box[i + 2]


def _shared(a: Column, b: Column, i: int) -> Column:
    (a0, a1), (b0, b1) = _side(a, i), _side(b, i)
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def iou(a: Column, b: Column) -> Column:
    common = _shared(a, b, 0) * _shared(a, b, 1)
    every = a[2] * a[3] + b[2] * b[3] - common
    return F.when(every > 0, common / every).otherwise(F.lit(0.0))


def envelope(a: Column, b: Column) -> Column:
    x0, y0 = F.least(a[0], b[0]), F.least(a[1], b[1])
    x1, y1 = F.greatest(a[0] + a[2], b[0] + b[2]), F.greatest(a[1] + a[3], b[1] + b[3])
    return F.array(x0, y0, x1 - x0, y1 - y0)


def near(a: Column, b: Column, gap: float) -> Column:
    def apart(i: int) -> Column:
        (a0, a1), (b0, b1) = _side(a, i), _side(b, i)
        return F.greatest(b0 - a1, a0 - b1)

    return (apart(0) <= gap) & (apart(1) <= gap)


def x_overlap(a: Column, b: Column) -> Column:
    narrow = F.least(a[2], b[2])
    return F.when(narrow > 0, _shared(a, b, 0) / narrow).otherwise(F.lit(0.0))


def caption(text: Column) -> Column:
    """(kind, number) of a line that begins as a caption: ``Figure 3.``, ``Fig. S2:``, ``Table 1b.``, ``Extended Data Fig. 4:``; null otherwise, as for a sentence about a figure."""
    pattern = r"(?i)^\s*(?:extended\s+data\s+)?(figure|fig\.?|table)\s+([a-z]?[0-9]+[a-z]?)\s*[.:]\s"
    kind, number = F.lower(F.regexp_extract(text, pattern, 1)), F.regexp_extract(text, pattern, 2)
    return F.when(number != "", F.struct(F.when(kind.startswith("fig"), "figure").otherwise("table").alias("kind"), number.alias("number")))


def _merge(gap: float, same: float):
    def box_iou(a, b) -> float:
        w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
        h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
        c = max(0.0, w) * max(0.0, h)
        e = a[2] * a[3] + b[2] * b[3] - c
        return c / e if e > 0 else 0.0

    def close(a, b) -> bool:
        return max(b[0] - a[0] - a[2], a[0] - b[0] - b[2]) <= gap and max(b[1] - a[1] - a[3], a[1] - b[1] - b[3]) <= gap

    def of(page, rows: list[tuple]) -> list[tuple]:
        known: list[tuple[str, list[float]]] = []
        for _, source, *b in sorted(rows, key=lambda r: (-SOURCE_RANK.get(r[1], 0), r[3], r[2])):
            if all(box_iou(b, o) <= same for _, o in known):
                known.append((source, list(b)))
        tables = [x for x in known if x[0] == "table"]
        rest = [x for x in known if x[0] != "table"]
        while True:  # to a fixed point: a round that joins anything leaves fewer
            joined: list[tuple[str, list[float]]] = []
            for source, b in rest:
                i = next((i for i, (_, o) in enumerate(joined) if close(b, o)), None)
                if i is None:
                    joined.append((source, b))
                else:
                    o = joined[i][1]
                    x, y = min(o[0], b[0]), min(o[1], b[1])
                    joined[i] = ("merged", [x, y, max(o[0] + o[2], b[0] + b[2]) - x, max(o[1] + o[3], b[1] + b[3]) - y])
            if len(joined) == len(rest):
                break
            rest = joined
        out = sorted(tables + rest, key=lambda x: (x[1][1], x[1][0]))
        return [(page, n, source, *b) for n, (source, b) in enumerate(out)]

    return of


def merge_regions(regions: DataFrame, least_area: float, most_area: float, gap: float, same: float) -> DataFrame:
    """Per page: regions within the area bounds, near-equal ones once (of the higher source), near fragments merged to a
    fixed point, in reading order. Tables (``source``) are whole already and take no part in merging."""
    area = F.col("w") * F.col("h")
    kept = regions.where((area >= least_area) & (area <= most_area))
    schema = "page_id bigint, region int, source string, x double, y double, w double, h double"
    return map_groups(kept, "page_id", _merge(gap, same), schema, ["page_id", "source", "x", "y", "w", "h"])


def match_captions(regions: DataFrame, captions: DataFrame, most_distance: float = 0.1, least_overlap: float = 0.3, margin: float = 0.15) -> DataFrame:
    """(page_id, caption, region, score, confidence): each caption and region used once, best scores first.

    The score is half vertical nearness, three tenths horizontal overlap and two tenths custom: figures have their
    caption (``kind``) below, tables above. Confidence is high where no other region comes within ``margin`` for the caption.
    Candidates are an equi-join on the page with the distance as a filter; the greedy choice runs per page.
    """
    r = regions.select("page_id", "region", F.array("x", "y", "w", "h").alias("rb"))
    c = captions.select("page_id", "caption", "kind", F.array("x", "y", "w", "h").alias("cb"))
    rb, cb = F.col("rb"), F.col("cb")
    both = r.join(c, "page_id").withColumn("overlap", x_overlap(rb, cb))
    below, above = cb[1] - (rb[1] + rb[3]), rb[1] - (cb[1] + cb[3])
    both = both.withColumn("distance", F.when(below >= 0, below).when(above >= 0, above).otherwise(F.lit(0.0)))
    usual = F.coalesce((F.col("kind") == "figure") & (below >= 0) | (F.col("kind") == "table") & (below < 0) & (above >= 0), F.lit(False))
    both = both.where((F.col("distance") <= most_distance) & (F.col("overlap") >= least_overlap))
    score = (1 - F.col("distance") / most_distance) * 0.5 + F.col("overlap") * 0.3 + F.when(usual, 0.2).otherwise(0.0)
    both = both.withColumn("score", F.round(score, 6))

    def choose(page, rows: list[tuple]) -> list[tuple]:
        used_r, used_c, out = set(), set(), []
        for _, cap, region, s in sorted(rows, key=lambda x: (-x[3], x[1], x[2])):
            if region not in used_r and cap not in used_c:
                used_r.add(region)
                used_c.add(cap)
                rivals = [x[3] for x in rows if x[1] == cap and x[2] != region]
                out.append((page, cap, region, s, "high" if not rivals or s - max(rivals) >= margin else "medium"))
        return out

    return map_groups(both, "page_id", choose, "page_id bigint, caption int, region int, score double, confidence string", ["page_id", "caption", "region", "score"])
