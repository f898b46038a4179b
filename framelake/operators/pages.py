"""Page tables: numbering, summaries, reordering, aspects, borders and boxes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions import stacks as sk


def page_numbers(pages: DataFrame) -> DataFrame:
    """``number``: place among the kept pages of a project in page order; null for others."""
    kept = (F.col("status") == "keep").cast("int")
    w = Window.partitionBy("project").orderBy("ord")
    return pages.withColumn("number", F.when(F.col("status") == "keep", F.sum(kept).over(w)))


def summary(pages: DataFrame) -> DataFrame:
    """Counts of a project's pages by status, and of all manual ones."""
    n = lambda c: F.count_if(c)
    s = F.col("status")
    return pages.groupBy("project").agg(F.count(F.lit(1)).alias("total"), n(s == "keep").alias("kept"), n(s == "duplicate").alias("duplicates"), n(s == "blank").alias("blanks"), n(s == "deleted").alias("deleted"), n(F.col("source") == "manual").alias("manual"))


def full_summary(pages: DataFrame, segments: DataFrame) -> DataFrame:
    """The nine counts of each project: its segments (project, a row each), kept pages, merged and possible duplicates, blank and
    deleted pages, kept short and moving ones, and all manual ones. Projects without pages or without segments have zeros there."""
    s = F.col("status")
    kept = lambda flag: F.count_if((s == "keep") & F.coalesce(F.array_contains("flags", flag), F.lit(False)))
    counts = {
        "pages": F.count_if(s == "keep"), "duplicates_merged": F.count_if(s == "duplicate"), "possible_duplicates": kept("possible_duplicate"), "blank": F.count_if(s == "blank"),
        "deleted": F.count_if(s == "deleted"), "short": kept("short"), "moving": kept("moving"), "manual": F.count_if(F.col("source") == "manual"),
    }
    of = pages.groupBy("project").agg(*[v.alias(k) for k, v in counts.items()])
    n = segments.groupBy("project").agg(F.count(F.lit(1)).alias("segments"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return of.join(n, "project", "full").select("project", zero("segments"), *[zero(c) for c in counts])


def move(pages: DataFrame, page_id: Column, to: int) -> DataFrame:
    """Pages of each project with the page ``page_id`` moved to place ``to`` (from 0, clamped)."""
    moved = pages.withColumn("_m", F.col("id") == page_id)
    w = Window.partitionBy("project").orderBy("_m", "ord")
    place = F.row_number().over(w) - 1
    key = F.when(F.col("_m"), F.lit(to) - 0.5).otherwise(place.cast("double"))
    return moved.withColumn("_k", key).withColumn("ord", F.row_number().over(Window.partitionBy("project").orderBy("_k", "ord")) - 1).drop("_m", "_k")


def by_time(pages: DataFrame) -> DataFrame:
    """Pages of each project renumbered (``ord`` from 0) in order of time, equal times in their old order."""
    return pages.withColumn("ord", F.row_number().over(Window.partitionBy("project").orderBy("t", "ord")) - 1)


def insert_by_time(pages: DataFrame, new: DataFrame) -> DataFrame:
    """``pages`` with the pages ``new`` (project, id, t, ...) inserted, each before the first page in page order that is later.

    Pages that are not in order of time stay as they are. New pages at one place go by time, those of one time by id; missing columns are null.
    """
    n = new.withColumn("_new", F.lit(1))
    # the running greatest time up to a page: the first page later than t is the first where it exceeds t
    top = F.max("t").over(Window.partitionBy("project").orderBy("ord"))
    old = pages.withColumn("_new", F.lit(0)).withColumn("_top", top)
    both = old.unionByName(n.withColumn("_top", F.col("t")), allowMissingColumns=True)
    # at equal times an existing page comes first: it is not later
    order = Window.partitionBy("project").orderBy("_top", "_new", "ord", "t", "id")
    return both.withColumn("ord", F.row_number().over(order) - 1).drop("_new", "_top")


def with_manual(detected: DataFrame, before: DataFrame) -> DataFrame:
    """Newly detected pages and the manual pages of the table before, in order of time."""
    manual = before.where(F.col("source") == "manual").withColumn("_old", F.lit(1))
    both = detected.withColumn("_old", F.lit(0)).unionByName(manual, allowMissingColumns=True)
    return both.withColumn("ord", F.row_number().over(Window.partitionBy("project").orderBy("t", "_old", "ord")) - 1).drop("_old")


def saved(pages: DataFrame) -> DataFrame:
    """(project, state): a line of JSON for each page, nulls written out; lines stay rows, however many pages a project has."""
    return pages.select("project", F.to_json(F.struct(*pages.columns), {"ignoreNullFields": "false"}).alias("state"))


def loaded(states: DataFrame, schema: str, images: DataFrame) -> DataFrame:
    """Pages of saved states, for the projects of which every page's image is among ``images`` (project, id)."""
    pages = states.select(F.from_json("state", schema).alias("p")).select("p.*")
    missing = pages.join(images, ["project", "id"], "left_anti").select("project").distinct()
    return pages.join(missing, "project", "left_anti")


def sharpest(frames: DataFrame) -> DataFrame:
    """(g, i, sharpness): the sharpest frame of each group, the first of equals."""
    best = F.min(F.struct((-F.col("sharpness")).alias("s"), "i"))
    return frames.groupBy("g").agg(best.alias("b")).select("g", "b.i", (-F.col("b.s")).alias("sharpness"))


#: Flags of kept pages that someone should look at. Fixed values.
LOOK = ("possible_duplicate", "short", "moving")


def needs_look(status: Column, flags: Column) -> Column:
    return (status == "keep") & F.coalesce(F.arrays_overlap(flags, F.array(*[F.lit(f) for f in LOOK])), F.lit(False))


def view(status: Column, flags: Column) -> Column:
    """The narrowest view of a page table that a page is in: ``hidden``, ``look`` or ``all``."""
    return F.when(status != "keep", "hidden").when(needs_look(status, flags), "look").otherwise("all")


def badges(page: DataFrame) -> DataFrame:
    """``badges``: what to say of each page (project, id, status, source, flags, dup_of, t_start, t_end, number).

    ``number`` is the page's own, see ``page_numbers``; that of ``dup_of`` is looked up by a join.
    """
    ref = page.select("project", F.col("id").alias("dup_of"), F.col("number").alias("_ref"))
    p = page.join(ref, ["project", "dup_of"], "left")
    has = lambda f: F.coalesce(F.array_contains("flags", f), F.lit(False))
    kept = F.col("status") == "keep"
    named = F.coalesce(F.col("_ref").cast("string"), F.lit("None"))
    seconds = F.format_string("%.1f", F.col("t_end") - F.col("t_start"))
    said = [
        F.when(F.col("status") == "duplicate", F.concat(F.lit("repeat of p. "), named, F.lit(" (hidden)"))).when(F.col("status") == "blank", "blank frame (hidden)").when(F.col("status") == "deleted", "deleted"),
        F.when(kept & has("possible_duplicate"), F.coalesce(F.concat(F.lit("looks like p. "), F.col("_ref").cast("string")), F.lit("possible repeat"))),
        F.when(kept & has("short"), F.concat(F.lit("brief ("), seconds, F.lit("s)"))),
        F.when(kept & has("moving"), "moving shot"),
        F.when(has("picked") & (F.col("source") != "manual"), "frame picked"),
        F.when(F.col("source") == "manual", "added by you"),
    ]
    return p.withColumn("badges", F.array_compact(F.array(*said))).drop("_ref")


def check_expected(pages: DataFrame, expected: DataFrame, counts: DataFrame, current: float = 0.5) -> DataFrame:
    """(project, expected, detected, ok, sensitivity, predicted) by project of ``expected`` (project, expected).

    ``counts`` (project, sensitivity, segments) are a sweep's. Where the number of kept pages differs,
    the sensitivity is given whose segments, less hidden automatic pages and with kept manual ones, come
    nearest to what is expected, then the one nearest the ``current``; only if nearer than now. An expectation of
    null or 0 is none: nothing is said of it.
    """
    kept, auto = F.col("status") == "keep", F.col("source") == "auto"
    have = pages.groupBy("project").agg(F.count_if(kept).alias("detected"), F.count_if(auto & ~kept).alias("_hidden"), F.count_if(~auto & kept).alias("_manual"))
    e = expected.join(have, "project", "left").select("project", "expected", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("detected", "_hidden", "_manual")])
    guess = e.join(counts, "project").withColumn("_p", F.col("segments") - F.col("_hidden") + F.col("_manual"))
    away = F.struct(F.abs(F.col("_p") - F.col("expected")), F.round(F.abs(F.col("sensitivity") - current), 9), "sensitivity")
    best = guess.groupBy("project").agg(F.min_by(F.struct("sensitivity", "_p"), away).alias("b"))
    x = e.join(best, "project", "left")
    better = (F.abs(F.col("b._p") - F.col("expected")) < F.abs(F.col("detected") - F.col("expected"))) & (F.abs(F.col("b.sensitivity") - current) > 1e-6)
    told = lambda c: F.when((F.col("detected") != F.col("expected")) & better, F.col(c))
    asked = F.coalesce(F.col("expected") != 0, F.lit(False))
    return x.select("project", "expected", "detected", F.when(asked, F.col("detected") == F.col("expected")).alias("ok"), F.when(asked, told("b.sensitivity")).alias("sensitivity"), F.when(asked, told("b._p")).alias("predicted"))


def best_aspect(aspects: DataFrame, exact: int = 400) -> DataFrame:
    """(g, aspect, cost): the candidate with the least sum of 1 - min/max against all aspects of its group.

    Candidates are the distinct aspects to four places, or 201 quantiles of groups of more
    than ``exact`` aspects, a rule of the result and not of its cost; so the join stays
    linear in the rows. Null and non-positive ones are left out.
    """
    a = aspects.where("aspect > 0")
    quantiles = F.percentile("aspect", F.array(*[F.lit(k / 200) for k in range(201)]))
    c = a.groupBy("g").agg(F.count(F.lit(1)).alias("n"), quantiles.alias("q"))
    many = c.where(F.col("n") > exact).select("g", F.explode(F.array_distinct("q")).alias("c"))
    few = a.join(c.where(F.col("n") <= exact).select("g"), "g", "left_semi").select("g", F.round("aspect", 4).alias("c")).distinct()
    # equal aspects meet a candidate once, with their number
    of = a.groupBy("g", "aspect").agg(F.count(F.lit(1)).alias("_n"))
    cost = of.join(few.unionByName(many), "g").groupBy("g", "c").agg(F.round(F.sum((1 - F.least("aspect", "c") / F.greatest("aspect", "c")) * F.col("_n")), 6).alias("cost"))
    return cost.groupBy("g").agg(F.min(F.struct("cost", "c")).alias("m")).select("g", F.col("m.c").alias("aspect"), F.col("m.cost").alias("cost"))


def pixels(images: DataFrame, width: int) -> DataFrame:
    """(g, id, y, x, v) of images given as arrays of ``width`` columns."""
    p = images.select("g", "id", F.posexplode("v").alias("k", "v"))
    return p.select("g", "id", F.floor(F.col("k") / width).cast("int").alias("y"), (F.col("k") % width).alias("x"), "v")


def static_border(px: DataFrame, threshold: float = 12.0, share: float = 0.9, least_pages: int = 3, least_moving: float = 0.2) -> DataFrame:
    """(g, top, bottom, left, right): rows and columns at each edge that hardly change over a group's pages.

    No row for a group with fewer than ``least_pages`` pages, with pages of several sizes, or of
    which less than ``least_moving`` of the rows or columns lies between the edges. One row and column always does.
    """
    sizes = px.groupBy("g", "id").agg(F.max("y").alias("h"), F.max("x").alias("w")).groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("h0"), F.max("h").alias("h1"), F.min("w").alias("w0"), F.max("w").alias("w1"))
    alike = sizes.where((F.col("n") >= least_pages) & (F.col("h0") == F.col("h1")) & (F.col("w0") == F.col("w1"))).select("g")
    cell = px.join(alike, "g", "left_semi").groupBy("g", "y", "x").agg((F.max("v") - F.min("v") < threshold).cast("int").alias("still"))

    def edges(axis: str, low: str, high: str) -> DataFrame:
        line = cell.groupBy("g", axis).agg((F.avg("still") >= share).alias("s"))
        first, last = F.min(F.when(~F.col("s"), F.col(axis))), F.max(F.when(~F.col("s"), F.col(axis)))
        size = F.max(axis) + 1
        e = line.groupBy("g").agg(F.coalesce(first, size - 1).alias(low), F.coalesce(size - 1 - last, F.lit(0)).alias(high), size.alias("_n"))
        return e.where(F.col("_n") - F.col(low) - F.col(high) >= least_moving * F.col("_n")).drop("_n")

    return edges("y", "top", "bottom").join(edges("x", "left", "right"), "g")


def trim_uniform(v: Column, w: int, h: int, tol: float = 5.0, color_tol: float = 12.0, least: int = 8) -> Column:
    """(x0, y0, x1, y1) of a picture without flat bars of the colour at its very edge.

    Top, bottom, left and right are trimmed in turn, each within what the ones before left: a bar is the lines
    from the edge on whose deviation is below ``tol`` and whose mean is within ``color_tol`` of the edge line's;
    ``least`` lines stay. The bar's end is the first line that breaks it. Pictures are worked on in batches where they are.
    """

    def kernel(p: np.ndarray) -> dict[str, np.ndarray]:
        n, every = len(p), np.arange(len(p))
        ends = {"x": [np.zeros(n, int), np.full(n, w)], "y": [np.zeros(n, int), np.full(n, h)]}
        within = lambda axis, size: (np.arange(size) >= ends[axis][0][:, None]) & (np.arange(size) < ends[axis][1][:, None])
        for axis, far, size, across in (("y", 0, h, ("x", w, 2)), ("y", 1, h, ("x", w, 2)), ("x", 0, w, ("y", h, 1)), ("x", 1, w, ("y", h, 1))):
            lo, hi = ends[axis]
            used = np.expand_dims(within(*across[:2]), 3 - across[2])
            count = used.sum(across[2])
            mean = (p * used).sum(across[2]) / count
            deviation = np.sqrt(((p - np.expand_dims(mean, across[2])) ** 2 * used).sum(across[2]) / count)
            edge = mean[every, hi - 1 if far else lo][:, None]
            breaks = within(axis, size) & ((deviation >= tol) | (abs(mean - edge) > color_tol))
            depth = hi[:, None] - 1 - np.arange(size) if far else np.arange(size) - lo[:, None]
            cut = np.maximum(np.minimum(np.where(breaks, depth, (hi - lo)[:, None]).min(1), hi - lo - least), 0)
            ends[axis][far] = hi - cut if far else lo + cut
        return {"x0": ends["x"][0], "y0": ends["y"][0], "x1": ends["x"][1], "y1": ends["y"][1]}

    return sk.mapped(kernel, "x0 int, y0 int, x1 int, y1 int", w, h, v)


def profile_extent(profile: DataFrame, rel: float) -> DataFrame:
    """(g, lo, hi): first and last place (plus one) of a profile (g, i, v) whose smoothed value reaches ``rel`` of its 90th percentile.

    Smoothing is a mean over a fiftieth of the places (odd, 3 at least), with zeros beyond the ends. Without such a place: all.
    A place's sum is the difference of two running sums, whatever the length of the window.
    """
    place = Window.partitionBy("g").orderBy("i")
    n = F.count(F.lit(1)).over(Window.partitionBy("g"))
    win = F.greatest(F.lit(3), F.rint(n * 0.02).cast("int").bitwiseOR(F.lit(1)))
    p = profile.select("g", "i", "v", n.alias("n"), win.alias("win")).withColumn("up_to", F.sum("v").over(place))
    p = p.withColumn("reach", F.floor(F.col("win") / 2).cast("long"))
    # each running sum is dealt to the place whose window ends there and to the one whose window begins after it
    ends = F.array(F.struct((F.col("i") - F.col("reach")).alias("i"), F.col("up_to").alias("x")), F.struct((F.col("i") + F.col("reach") + 1).alias("i"), (-F.col("up_to")).alias("x")))
    # windows that reach beyond the last place end with the whole sum
    beyond = F.transform(F.sequence(F.col("n") - F.col("reach"), F.col("n") - 1), lambda i: F.struct(i.alias("i"), F.col("up_to").alias("x")))
    dealt = p.select("g", "n", "win", F.inline(F.when(F.col("i") == F.col("n") - 1, F.concat(ends, beyond)).otherwise(ends)))
    sums = dealt.where("i >= 0 and i < n").groupBy("g", "n", "i").agg((F.sum("x") / F.first("win")).alias("s"))
    ref = sums.groupBy("g").agg(F.expr("percentile(s, 0.9)").alias("ref"))
    x = sums.join(ref, "g")
    on = (F.col("s") >= F.lit(rel) * F.col("ref")) & (F.col("ref") > 0)
    return x.groupBy("g").agg(F.coalesce(F.min(F.when(on, F.col("i"))), F.lit(0)).alias("lo"), F.coalesce(F.max(F.when(on, F.col("i"))) + 1, F.max("n")).alias("hi"))


def temporal_median(px: DataFrame) -> DataFrame:
    """(g, y, x, m): lower median of each pixel over the frames of a segment."""
    m = F.get(F.array_sort(F.collect_list("v")), F.floor((F.count(F.lit(1)) - 1) / 2).cast("int"))
    return px.groupBy("g", "y", "x").agg(m.alias("m"))


def iou(a: Column, b: Column) -> Column:
    """Overlap of two boxes (x0, y0, x1, y1) by their union; 0 where it is empty."""
    area = lambda q: (q["x1"] - q["x0"]) * (q["y1"] - q["y0"])
    side = lambda lo, hi: F.greatest(F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]), F.lit(0))
    inter = side("x0", "x1") * side("y0", "y1")
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def box_scale(box: Column, scale: Column, w: Column, h: Column) -> Column:
    """A box of a scaled image in pixels of the whole one, rounded outwards and clamped."""
    down = lambda c: F.greatest(F.floor(box[c] / scale), F.lit(0)).cast("int")
    up = lambda c, n: F.least(F.ceil(box[c] / scale), n).cast("int")
    return F.struct(down("x0").alias("x0"), down("y0").alias("y0"), up("x1", w).alias("x1"), up("y1", h).alias("y1"))


def order_quad(points: Column) -> Column:
    """Four points (x, y) as top left, top right, bottom right, bottom left; of equals the first."""
    best = lambda score: F.array_min(F.transform(points, lambda p, i: F.struct(score(p).alias("k"), i.alias("i"), p.alias("p"))))["p"]
    return F.array(best(lambda p: p["x"] + p["y"]), best(lambda p: p["y"] - p["x"]), best(lambda p: -p["x"] - p["y"]), best(lambda p: p["x"] - p["y"]))


def parse_crop(text: Column) -> Column:
    """(mode, box) of ``auto``, ``none`` or four fractions 'x0,y0,x1,y1' of the frame; an error for anything else."""
    parts = F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("double"))
    good = (F.size(parts) == 4) & F.forall(parts, lambda x: F.coalesce(x.between(0, 1), F.lit(False)))
    wrong = F.raise_error(F.concat(F.lit("a crop is auto, none or four fractions: "), text)).cast("struct<mode:string,box:array<double>>")
    of = lambda mode, box: F.struct(mode.alias("mode"), box.alias("box"))
    return F.when(text.isin("auto", "none"), of(text, F.lit(None).cast("array<double>"))).when(good, of(F.lit("manual"), parts)).when(text.isNotNull(), wrong)


def manual_crop(x0: Column, y0: Column, x1: Column, y1: Column, w: Column, h: Column) -> Column:
    """A relative rectangle, corners in any order, as pixels: clamped and at least one pixel."""
    lo = lambda p, q, n: F.least(F.greatest(F.rint(F.least(p, q) * n), F.lit(0.0)), n - 1).cast("int")
    hi = lambda p, q, n: F.greatest(F.least(F.rint(F.greatest(p, q) * n), n.cast("double")).cast("int"), lo(p, q, n) + 1)
    return F.struct(lo(x0, x1, w).alias("x0"), lo(y0, y1, h).alias("y0"), hi(x0, x1, w).alias("x1"), hi(y0, y1, h).alias("y1"))
