"""Layout of text in picture panels: words to lines, lines to blocks, and the geometry of captions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONFIDENCE = 40
PAD = 6
STRIP_SHARE, STRIP_LEAST = 0.42, 30
COVERED = 0.12
FLAT, THIN, NARROW, DARK, BRIGHT, DEPTH = 8.0, 3, 40, 40, 215, 6
WEAK, STRONG, VOTES, RUN, GAP, SEAM, MERGE = 50, 150, 60, 0.3, 12, 0.55, 3


def whole(c: Column) -> Column:
    return c.cast("int")


def text_lines(words: DataFrame, keys: list[str], scale: Column | float = 1.0) -> DataFrame:
    """Lines of recognised words (keys, block_num, par_num, line_num, word_num, left, top, width, height, conf, text).

    Words of confidence under 40 and blank ones are dropped; a line's box covers its words, its text joins them in order.
    """
    s = F.lit(scale) if isinstance(scale, (int, float)) else scale
    kept = words.filter((F.col("conf").cast("int") >= CONFIDENCE) & (F.trim("text") != ""))
    line = kept.groupBy(*keys, "block_num", "par_num", "line_num").agg(
        (F.min("left") / s).alias("_x"),
        (F.min("top") / s).alias("_y"),
        (F.max(F.col("left") + F.col("width")) / s).alias("_x2"),
        (F.max(F.col("top") + F.col("height")) / s).alias("_y2"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_num", F.trim("text").alias("t")))), lambda w: w["t"]), " ").alias("text"),
    )
    return line.select(*keys, "block_num", "par_num", "line_num", whole(F.col("_x")).alias("x"), whole(F.col("_y")).alias("y"), whole(F.col("_x2")).alias("x2"), whole(F.col("_y2")).alias("y2"), whole(F.col("_y2") - F.col("_y")).alias("h"), "text")


def line_groups(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``grp``: within a block a new group begins where the gap above a line exceeds 1.2 times max(its height, 10)."""
    w = Window.partitionBy(*keys, "block_num").orderBy("y", "par_num", "line_num")
    gap = F.col("y") - F.lag("y2").over(w)
    starts = F.when(gap > F.greatest("h", F.lit(10)) * 1.2, 1).otherwise(0)
    return lines.withColumn("_s", starts).withColumn("grp", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_s")


def text_blocks(grouped: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks of grouped lines: box, text, number of lines and median height."""
    lines = F.array_sort(F.collect_list(F.struct("y", "par_num", "line_num", "text")))
    return grouped.groupBy(*keys, "block_num", "grp").agg(
        F.min("x").alias("x"),
        F.min("y").alias("y"),
        (F.max("x2") - F.min("x")).alias("w"),
        (F.max("y2") - F.min("y")).alias("h"),
        F.array_join(F.transform(lines, lambda v: v["text"]), "\n").alias("text"),
        F.count("*").cast("int").alias("lines"),
        whole(F.median("h")).alias("font_px"),
    )


def position(y: Column, h: Column, panel_height: Column) -> Column:
    """top, middle or bottom: the third of the panel that holds the block's middle, relative to the panel."""
    middle = y + h / 2
    return F.when(middle < panel_height / 3, "top").when(middle > 2 * panel_height / 3, "bottom").otherwise("middle")


def panel_blocks(words: DataFrame, panels: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks placed in the picture, from words and panels (keys, panel_x, panel_y, panel_w, panel_h) with keys in both."""
    blocks = text_blocks(line_groups(text_lines(words, keys), keys), keys).join(panels, keys)
    return blocks.withColumn("position", position(F.col("y"), F.col("h"), F.col("panel_h"))).withColumn("x", F.col("x") + F.col("panel_x")).withColumn("y", F.col("y") + F.col("panel_y"))


def analysis(blocks: DataFrame, panels: DataFrame) -> DataFrame:
    """One row per picture (image, width, height, panels), nested as in an analysis file.

    ``panels`` has image, width, height, panel and its box; ``blocks`` the placed blocks of each (image, panel).
    """
    block = F.struct(F.array("x", "y", "w", "h").alias("bbox"), "text", "lines", "font_px", "position")
    per_panel = blocks.groupBy("image", "panel").agg(F.array_sort(F.collect_list(F.struct("block_num", "grp", block.alias("b")))).alias("_b")).select("image", "panel", F.transform("_b", lambda v: v["b"]).alias("text_blocks"))
    none = F.expr("cast(array() as array<struct<bbox:array<int>,text:string,lines:int,font_px:int,position:string>>)")
    one = F.struct(F.col("panel").alias("id"), F.array("panel_x", "panel_y", "panel_w", "panel_h").alias("bbox"), F.coalesce("text_blocks", none).alias("text_blocks"))
    return panels.join(per_panel, ["image", "panel"], "left").groupBy("image", "width", "height").agg(F.array_sort(F.collect_list(one)).alias("panels"))


def caption_region(px: Column, py: Column, pw: Column, ph: Column) -> Column:
    """The strip for a caption at the bottom of a panel: struct<x,y,w,h>."""
    rh = F.least(F.greatest(F.lit(STRIP_LEAST), whole(ph * STRIP_SHARE)), ph - 2 * PAD)
    return F.struct((px + PAD).alias("x"), (py + ph - rh - PAD).alias("y"), (pw - 2 * PAD).alias("w"), rh.alias("h"))


def clamped(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """A box widened by the padding and cut at the picture's edges: struct<x0,y0,x1,y1>."""
    return F.struct(F.greatest(x - PAD, F.lit(0)).alias("x0"), F.greatest(y - PAD, F.lit(0)).alias("y0"), F.least(x + w + PAD, width).alias("x1"), F.least(y + h + PAD, height).alias("y1"))


def strip_coverage(region: Column, boxes: Column) -> Column:
    """The share of a region that boxes (array<struct<x,y,w,h>>) cover, overlaps counted twice."""

    def shared(b: Column) -> Column:
        ix = F.least(b["x"] + b["w"], region["x"] + region["w"]) - F.greatest(b["x"], region["x"])
        iy = F.least(b["y"] + b["h"], region["y"] + region["h"]) - F.greatest(b["y"], region["y"])
        return F.greatest(F.lit(0), ix) * F.greatest(F.lit(0), iy)

    total = F.aggregate(F.transform(boxes, lambda b: shared(b).cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    return total / F.greatest(region["w"] * region["h"], F.lit(1))


def anchors(panels: DataFrame, blocks: DataFrame, captions: dict[str, str]) -> DataFrame:
    """Where captions go: for each captioned panel its strip, the size and box of its largest block, whether the strip
    must be cleared, and the size shared by the picture (whole number of the median of the panels' sizes)."""
    wanted = panels.filter(F.col("panel").cast("string").isin(list(captions)))
    per = blocks.groupBy("image", "panel").agg(
        F.max_by(F.struct("font_px", F.struct("x", "y", "w", "h").alias("box")), F.struct((F.col("w") * F.col("h")).alias("area"), (-F.col("block_num")).alias("b"), (-F.col("grp")).alias("g"))).alias("largest"),
        F.collect_list(F.struct("x", "y", "w", "h")).alias("boxes"),
    )
    none = F.expr("cast(array() as array<struct<x:int,y:int,w:int,h:int>>)")
    out = wanted.join(per, ["image", "panel"], "left").withColumn("region", caption_region(F.col("panel_x"), F.col("panel_y"), F.col("panel_w"), F.col("panel_h")))
    out = out.withColumn("coverage", strip_coverage(F.col("region"), F.coalesce("boxes", none))).withColumn("clear", F.col("coverage") < COVERED)
    shared = whole(F.median(F.when(F.col("largest.font_px") != 0, F.col("largest.font_px"))).over(Window.partitionBy("image")))
    text = F.create_map(*[F.lit(v) for kv in captions.items() for v in kv])[F.col("panel").cast("string")] if captions else F.lit(None).cast("string")
    return out.select("image", "panel", "region", F.col("largest.font_px").alias("font_px"), F.col("largest.box").alias("color_box"), "coverage", "clear", shared.alias("shared_px"), text.alias("caption"))


def segments(positions: Column, n: Column) -> Column:
    """The stretches between sorted positions from 0 to n: array<struct<start,end>>."""
    points = F.concat(F.array(F.lit(0)), F.array_sort(positions), F.array(n))
    return F.zip_with(F.slice(points, F.lit(1), F.size(points) - 1), F.slice(points, F.lit(2), F.size(points) - 1), lambda a, b: F.struct(a.alias("start"), b.alias("end")))


def plain_lines(part: np.ndarray, axis: int) -> np.ndarray:
    """Which lines along an axis are of nearly one colour: their standard deviation is under FLAT.

    Of bytes from whole sums, which floats hold exactly. Where a line's extremes are near it is plain, and where every eighth
    pixel deviates too much it is not (the squared deviations of some pixels are at most those of all); the rest is summed up.
    """
    if part.dtype != np.uint8:
        return part.std(axis=axis) < FLAT

    def squares(lines: np.ndarray) -> np.ndarray:
        """The squared deviations of each line, times its length."""
        g = lines.astype(float)
        return lines.shape[axis] * np.einsum("ij,ij->i" if axis else "ij,ij->j", g, g) - g.sum(axis=axis) ** 2

    n, plain = part.shape[axis], part.max(axis=axis) - part.min(axis=axis) < 2 * FLAT
    if plain.all():
        return plain
    some = part[:, ::8] if axis else part[::8]
    maybe = np.flatnonzero(~plain & (squares(some) < FLAT * FLAT * n * some.shape[axis]))
    if len(maybe):
        plain[maybe] = squares(part[maybe] if axis else part[:, maybe]) < FLAT * FLAT * n * n
    return plain


def gutter(spread: np.ndarray, mean: np.ndarray) -> tuple[int, int] | None:
    """The gutter nearest the middle: a run of at least 3 rows of nearly one colour, dark or bright, away from the edges."""
    return gutter_among(spread < FLAT, lambda a, b: mean[a:b].mean())


def gutter_among(plain: np.ndarray, mean: Callable[[int, int], float]) -> tuple[int, int] | None:
    """The gutter among lines of nearly one colour, given the mean brightness of lines a to b."""
    n = len(plain)
    if not plain.any():
        return None
    flat = np.zeros(n + 2, np.int8)
    flat[1:-1] = plain
    step = flat[1:] - flat[:-1]
    runs = zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist())
    found = [(a, b) for a, b in runs if b - a >= THIN and a >= NARROW and n - b >= NARROW and not DARK <= mean(a, b) <= BRIGHT]
    return min(found, key=lambda r: abs((r[0] + r[1]) / 2 - n / 2), default=None)


def edges(gray: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(across, upright): the pixels of edges that run across and upright in a gray picture.

    Gradients of a 3 x 3 neighbourhood; a pixel counts where none beside it across the edge is stronger and it is strong
    (WEAK to STRONG only if connected with a strong one).
    """
    across, upright = np.zeros(gray.shape, bool), np.zeros(gray.shape, bool)
    low, high = gray.min(axis=1), gray.max(axis=1)
    low[1:-1], high[1:-1] = np.minimum(np.minimum(low[:-2], low[1:-1]), low[2:]), np.maximum(np.maximum(high[:-2], high[1:-1]), high[2:])
    low[:1], low[-1:], high[:1], high[-1:] = gray[:2].min(), gray[-2:].min(), gray[:2].max(), gray[-2:].max()
    ys = np.flatnonzero((high - low) * 8.0 > WEAK)  # a gradient is at most 8 times the difference of its neighbourhood's extremes
    if not len(ys):
        return across, upright
    at, first, last = slice(ys[0], ys[-1] + 1), max(ys[0] - 2, 0), min(ys[-1] + 3, len(gray))  # the rest has no edges
    used, skipped = gray[first:last], ys[0] - first
    h, w = used.shape
    g = np.empty((h + 2, w + 2), np.int16 if gray.dtype == np.uint8 else float)
    g[1:-1, 1:-1] = used
    g[0, 1:-1], g[-1, 1:-1] = used[0], used[-1]
    g[:, 0], g[:, -1] = g[:, 1], g[:, -2]
    rows = g[:-2] + g[2:]
    rows += g[1:-1]
    rows += g[1:-1]
    columns = g[:, :-2] + g[:, 2:]
    columns += g[:, 1:-1]
    columns += g[:, 1:-1]
    gx, gy = np.abs(rows[:, 2:] - rows[:, :-2]), np.abs(columns[2:] - columns[:-2])
    wide = np.zeros_like(g)
    np.add(gx, gy, out=wide[1:-1, 1:-1])
    mine = slice(skipped, skipped + ys[-1] + 1 - ys[0])
    around = wide[mine.start : mine.stop + 2]
    size, flat = around[1:-1, 1:-1], gy[mine] >= gx[mine]
    ridge = flat & (size > around[:-2, 1:-1]) & (size >= around[2:, 1:-1])
    ridge |= ~flat & (size > around[1:-1, :-2]) & (size >= around[1:-1, 2:])
    on = connected(ridge & (size > WEAK), ridge & (size > STRONG))
    across[at], upright[at] = on & flat, on & ~flat
    return across, upright


def connected(weak: np.ndarray, strong: np.ndarray) -> np.ndarray:
    """The pixels of ``weak`` that touch one of ``strong`` (a part of it), at a corner or through others; each is visited once."""
    h, w = weak.shape
    on, left = np.zeros((h + 2, w + 2), bool), np.zeros((h + 2, w + 2), bool)
    on[1:-1, 1:-1], left[1:-1, 1:-1] = strong, weak & ~strong
    near = on.copy()
    near[1:] |= on[:-1]
    near[:-1] |= on[1:]
    beside = near.copy()
    beside[:, 1:] |= near[:, :-1]
    beside[:, :-1] |= near[:, 1:]
    on1, left1 = on.ravel(), left.ravel()
    around = np.array([i * (w + 2) + j for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
    new = np.flatnonzero(beside & left)
    while len(new):
        on1[new], left1[new] = True, False
        new = (new[:, None] + around).ravel()
        new = np.unique(new[left1[new]])
    return on[1:-1, 1:-1]


def seams(lines: np.ndarray) -> list[tuple[int, float]]:
    """(position, coverage) of straight seams in the edges that run across: rows where long straight runs cover most of the span.

    Text has strokes too short for such runs. Runs within 3 rows of one another count together.
    """
    n, span = lines.shape
    if not seamable(n, span) or not lines.any():
        return []
    wanted = np.flatnonzero(lines[NARROW : n - NARROW + 1].any(axis=1)) + NARROW
    three = lines[wanted - 1] | lines[wanted] | lines[wanted + 1]
    enough = np.count_nonzero(three, axis=1) >= VOTES
    if not enough.any():
        return []
    wanted = wanted[enough]
    at, on = np.nonzero(three[enough])
    ends = np.flatnonzero(np.r_[(np.diff(on) > GAP + 1) | (np.diff(at) > 0), True])
    starts = np.r_[0, ends[:-1] + 1]
    length, votes = on[ends] - on[starts] + 1, ends - starts + 1
    long = (length >= RUN * span) & (votes >= np.maximum(VOTES, 0.8 * length))
    covers: dict[int, np.ndarray] = {}
    for a, b, row in zip(on[starts[long]].tolist(), on[ends[long]].tolist(), wanted[at[ends[long]]].tolist()):
        covers.setdefault(row, np.zeros(span, bool))[a : b + 1] = True
    found: list[tuple[int, np.ndarray]] = []
    for row, cover in covers.items():
        near = next((k for k, (q, _) in enumerate(found) if abs(q - row) <= MERGE), None)
        if near is None:
            found.append((row, cover))
        else:
            found[near] = (found[near][0], found[near][1] | cover)
    return [(q, float(c.mean())) for q, c in found if c.mean() >= SEAM]


def seamable(n: int, span: int) -> bool:
    """Whether n rows of so many pixels can have a seam at all."""
    return n >= 2 * NARROW and span >= VOTES


def split_panels(gray: np.ndarray) -> list[tuple[int, int, int, int]]:
    """The panels (x, y, w, h) of a gray picture: cut at its gutters, rows before columns, and where there are none at the grid of
    its seams, at most 6 cuts deep."""
    out, todo = [], [(0, 0, gray.shape[1], gray.shape[0], 0)]
    while todo:
        x, y, w, h, depth = todo.pop()
        part = gray[y : y + h, x : x + w]
        ys, xs = [(0, h)], [(0, w)]
        extent = float(part.max()) - float(part.min()) if part.size else 0.0
        if depth < DEPTH and extent >= 2 * FLAT:  # else it is flat from edge to edge
            cut = gutter_among(plain_lines(part, 1), lambda a, b: part[a:b].mean()) if h >= 2 * NARROW else None
            if cut:
                ys = [(0, cut[0]), (cut[1], h)]
            elif w >= 2 * NARROW and (cut := gutter_among(plain_lines(part, 0), lambda a, b: part[:, a:b].mean())):
                xs = [(0, cut[0]), (cut[1], w)]
            elif (seamable(h, w) or seamable(w, h)) and 8 * extent > STRONG:  # else no gradient is strong
                across, upright = edges(part)
                rows, columns = ([0, *(q for q, _ in seams(e)), n] for e, n in ((across, h), (upright.T, w)))
                ys, xs = list(zip(rows, rows[1:])), list(zip(columns, columns[1:]))
        if len(ys) * len(xs) == 1:
            out.append((x, y, w, h))
        else:
            todo += [(x + x0, y + y0, x1 - x0, y1 - y0, depth + 1) for y0, y1 in reversed(ys) for x0, x1 in reversed(xs)]
    return out


def detect_panels(images: DataFrame) -> DataFrame:
    """(image, width, height, panel, panel_x, panel_y, panel_w, panel_h) of gray pictures (image, width, height, pixels as bytes)."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            out = []
            for image, width, height, pixels in zip(*(b.column(c).to_pylist() for c in ("image", "width", "height")), b.column("pixels")):
                gray = np.frombuffer(pixels.as_buffer(), np.uint8).reshape(height, width)  # not copied
                out += [(image, width, height, i, *box) for i, box in enumerate(split_panels(gray))]
            names = ("image", "width", "height", "panel", "panel_x", "panel_y", "panel_w", "panel_h")
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.string() if k == 0 else pa.int32()) for k in range(8)], list(names))

    return images.select("image", "width", "height", "pixels").mapInArrow(run, "image string, width int, height int, panel int, panel_x int, panel_y int, panel_w int, panel_h int")


def ink(bright: Column, dark: Column) -> Column:
    """Whether text is dark on bright: only if strictly more pixels are dark (under 55) than bright (over 200)."""
    return F.when(dark > bright, "black").otherwise("white")


def ink_counts(pictures: DataFrame) -> DataFrame:
    """(image, bright, dark): the pixels over 200 and under 55 in a box (x, y, w, h) of colour pictures (image, width, height, pixels as bytes, three a pixel).

    The box is cut at the picture's edges; an empty one has no pixels. A pixel's brightness is the mean of its colours.
    """
    import pyarrow as pa

    def run(batches):
        for b in batches:
            out = []
            for image, width, height, pixels, x, y, w, h in zip(*(b.column(c).to_pylist() for c in ("image", "width", "height", "pixels", "x", "y", "w", "h"))):
                crop = np.frombuffer(pixels, np.uint8).reshape(height, width, 3)[max(y, 0) : max(y + h, 0), max(x, 0) : max(x + w, 0)]
                level = crop.mean(axis=2) if crop.size else np.zeros(0)
                out.append((image, int((level > 200).sum()), int((level < 55).sum())))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.string() if k == 0 else pa.int32()) for k in range(3)], ["image", "bright", "dark"])

    return pictures.select("image", "width", "height", "pixels", "x", "y", "w", "h").mapInArrow(run, "image string, bright int, dark int")
