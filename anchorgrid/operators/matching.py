"""Choosing control words for anchor words, without replacement and seeded by md5."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from anchorgrid.functions.hashing import draw60
from anchorgrid.functions.values import half_even
from anchorgrid.operators.ordered import Ordered, with_group_size
from anchorgrid.operators.windows import nearest_distance
from anchorgrid.session import cut_lineage


class MatchError(ValueError):
    """The requested controls do not exist."""


def hashed_rank(df: DataFrame, keys: list[str], id_column: str, seed, name: str, most: int | None = None) -> DataFrame:
    """Row number in md5 order inside each key; ``most`` as in :class:`Ordered`."""
    ranked = df.withColumn("__h", draw60(seed, F.col(id_column)))
    return Ordered(ranked, keys, ["__h", id_column], most=most).numbered(name).done().drop("__h")


def coarse_controls(
    positives: DataFrame, references: DataFrame, pool: DataFrame, *, min_distance_ms: int,
    balance: float = 0.5, seed: int = 42, id_column: str = "word_id", t: str = "time_ms", required: bool = True,
) -> DataFrame:
    """Seeded sample of pool words at least ``min_distance_ms`` from every reference word.

    The sample size is set by the wanted positive share; too small a pool is an error, or, if the
    size is not ``required``, given out whole.
    """
    far = nearest_distance(pool, references, t=t, id_column=id_column)
    # read by the ranking and its count pass, so the distances are computed once
    far = cut_lineage(
        far.filter(F.col("distance_ms").isNull() | (F.col("distance_ms") >= min_distance_ms)))
    n = positives.count()
    wanted = int((n - balance * n) / balance)
    chosen = hashed_rank(far, [], id_column, seed, "__rank").filter(F.col("__rank") <= wanted)
    have = chosen.count() if required else wanted
    if have < wanted:
        raise MatchError(f"{wanted} controls wanted, {have} far enough from every cue")
    return chosen.drop("__rank", "distance_ms")


def paired_by_rank(
    cues: DataFrame, pool: DataFrame, keys: list[str], *, seed: int = 42,
    cue_id: str = "cue_id", control_id: str = "control_id",
) -> DataFrame:
    """Pair the i-th cue with the i-th control of a key, both in md5 order.

    Right when every control of a key suits every cue of it: the number of pairs is then the
    smaller side of each key.
    """
    left = hashed_rank(cues, keys, cue_id, f"{seed}:cue", "__rank")
    right = hashed_rank(pool, keys, control_id, f"{seed}:control", "__rank")
    return left.join(right, [*keys, "__rank"]).select(*keys, cue_id, control_id)


def assign_in_order(edges: DataFrame) -> DataFrame:
    """Sequential greedy choice as rounds of proposals.

    edges: cue, control, priority (small goes first, same for all edges of a cue) and wish
    (small is preferred). Every cue holds its best remaining control, every control keeps the
    cue with the best priority, refused edges go. All controls rank cues alike, so the fixed
    point equals walking through the cues in priority order and taking the best free control.
    """
    rest = edges
    while True:
        best = rest.groupBy("cue").agg(
            F.min_by(F.struct("control", "priority"), F.struct("wish", "control")).alias("p")
        ).select("cue", "p.control", "p.priority")
        holder = best.groupBy("control").agg(
            F.min_by("cue", F.struct("priority", "cue")).alias("holder")
        )
        refused = best.join(holder, "control").filter(F.col("cue") != F.col("holder"))
        refused = cut_lineage(refused.select("cue", "control"))
        if refused.isEmpty():
            return best.select("cue", "control")
        rest = cut_lineage(rest.join(refused, ["cue", "control"], "left_anti"))


def scope_controls(scope_edges: DataFrame, cue_ids: DataFrame, *, seed: int = 42) -> DataFrame:
    """``neg`` mode: one own-scope word per cue, cues with the fewest candidates first.

    scope_edges: cue_id, word_id (own scope words far enough away); a word that is itself a
    cue is never a control.
    """
    usable = scope_edges.join(
        cue_ids.select(F.col("cue_id").alias("word_id")), "word_id", "left_anti"
    )
    usable = with_group_size(usable, ["cue_id"], "__n")
    edges = usable.select(
        F.col("cue_id").alias("cue"), F.col("word_id").alias("control"),
        F.struct(F.col("__n"), draw60(seed, "cue", F.col("cue_id"))).alias("priority"),
        draw60(seed, "control", F.col("word_id")).alias("wish"),
    )
    return assign_in_order(cut_lineage(edges)).select(
        F.col("cue").alias("cue_id"), F.col("control").alias("control_id")
    )


STEP_MS = 10_000
MIN_CUE_DISTANCE_MS = 1_000
ROUNDS = 2  # of random choice before what is left is matched along the time line
PAIR = ["cue_id", "control_id", "distance_ms"]


def search_radius(nearest: Column, step_ms: int = STEP_MS) -> Column:
    """First multiple of the step that contains the nearest distance."""
    return F.greatest(F.lit(step_ms), F.ceil(nearest / F.lit(step_ms)) * step_ms)


def strict_controls(
    cues: DataFrame, pool: DataFrame, *, group: list[str], chunk: str, seed: int = 42,
    min_distance_ms: int = MIN_CUE_DISTANCE_MS,
) -> DataFrame:
    """``strict`` mode: same group and chunk first, then the group with a growing radius.

    cues: cue_id, time_ms; pool: control_id, time_ms; both with group and chunk. Returns
    cue_id, control_id, stage ('chunk' or 'radius') and distance_ms. Cues without any
    remaining control are left out, and no cue is left out while its group has a free control
    far enough away.

    Inside a chunk nearly every control suits every cue, so cues and controls are paired by
    md5 ranks. In the radius stage a cue draws one of the free controls inside its first
    ten-second step that holds one; the cue with the fewest controls wins a contested one. Both
    stages run ``ROUNDS`` times, and what conflicts leave over is matched like brackets on the
    time line. The number of joins does not depend on the data, and no pair list is built.
    The rows of the largest group are counted once, as no time line of any step is longer.
    """
    cues = cut_lineage(cues.select(*group, chunk, "cue_id", F.col("time_ms").alias("cue_ms")))
    free = cut_lineage(pool.select(*group, chunk, "control_id", F.col("time_ms").alias("control_ms")))
    most = _longest_line(cues, free, group)
    inside = _matched(cues, free, [*group, chunk], seed, min_distance_ms, _paired_suitable, most).withColumn("stage", F.lit("chunk"))
    cues = cut_lineage(cues.join(inside, "cue_id", "left_anti"))
    free = cut_lineage(free.join(inside, "control_id", "left_anti"))
    outside = _matched(cues, free, group, seed, min_distance_ms, _drawn_suitable, most).withColumn("stage", F.lit("radius"))
    return inside.unionByName(outside)


MARKS = 4  # places of a cue on a time line at most


def _longest_line(cues: DataFrame, free: DataFrame, keys: list[str]) -> int:
    """Rows of the largest key with all marks of its cues; finer keys and what a step leaves over have no more."""
    rows = cues.select(*keys, F.lit(MARKS).alias("__n")).unionByName(free.select(*keys, F.lit(1).alias("__n")))
    return rows.groupBy(*keys).agg(F.sum("__n").alias("__n")).agg(F.max("__n")).first()[0] or 0


def _matched(cues: DataFrame, free: DataFrame, keys: list[str], seed, gap: int, choose, most: int | None = None) -> DataFrame:
    """(cue_id, control_id, distance_ms): rounds of ``choose``, then controls before and after the cues left."""
    done = None
    steps = [lambda c, f, turn=turn: choose(c, f, keys, f"{seed}:{turn}", gap, most) for turn in range(ROUNDS)]
    steps += [lambda c, f, side=side: _bracketed(c, f, keys, gap, side, most) for side in (-1, 1)]
    for step in steps:
        pairs = cut_lineage(step(cues, free))
        done = pairs if done is None else done.unionByName(pairs)
        cues, free = cues.join(pairs, "cue_id", "left_anti"), free.join(pairs, "control_id", "left_anti")
        cues, free = cut_lineage(cues), cut_lineage(free)
    return done


def _paired_suitable(cues: DataFrame, free: DataFrame, keys: list[str], seed, gap: int, most: int | None = None) -> DataFrame:
    """Cues and controls of a key with equal md5 ranks, where they are far enough apart."""
    left = hashed_rank(cues, keys, "cue_id", f"{seed}:cue", "__rank", most)
    right = hashed_rank(free, keys, "control_id", f"{seed}:control", "__rank", most)
    pairs = left.join(right.select(*keys, "__rank", "control_id", "control_ms"), [*keys, "__rank"])
    return pairs.withColumn("distance_ms", F.abs(F.col("cue_ms") - F.col("control_ms"))).filter(F.col("distance_ms") >= gap).select(*PAIR)


def _drawn_suitable(cues: DataFrame, free: DataFrame, keys: list[str], seed, gap: int, most: int | None = None) -> DataFrame:
    """Each cue draws a control between ``gap`` and its search radius; a contested one goes to the cue with the fewest controls."""
    near = _nearest_suitable(cues, free, keys, gap, most)
    # read for the marks and for the wishes, so the time line behind it is walked once
    asked = cut_lineage(cues.join(near.select("cue_id", "__n", search_radius(F.col("distance_ms")).alias("__r")), "cue_id"))
    # how many controls of the key lie before each end of the two stretches that hold candidates
    ends = {"__a": (-F.col("__r"), False), "__b": (F.lit(-gap), True), "__c": (F.lit(gap), False), "__d": (F.col("__r"), True)}
    marks = asked.select(*keys, "cue_id", F.explode(F.array(*[
        F.struct(F.lit(name).alias("mark"), (F.col("cue_ms") + shift).cast("bigint").alias("t"), F.lit(2 if closed else 0).alias("kind"))
        for name, (shift, closed) in ends.items()])).alias("m")).select(*keys, "m.t", "m.kind", F.col("cue_id").alias("id"), "m.mark")
    points = free.select(*keys, F.col("control_ms").alias("t"), F.lit(1).alias("kind"), F.col("control_id").alias("id"), F.lit("").alias("mark"))
    line = Ordered(marks.unionByName(points), keys, ["t", "kind", "id", "mark"], most=most).running({"upto": (F.col("kind") == 1).cast("bigint")}).done()
    counted = line.filter("kind <> 1").groupBy(F.col("id").alias("cue_id")).agg(*[F.max(F.when(F.col("mark") == name, F.col("upto"))).alias(name) for name in ends])
    before, after = F.col("__b") - F.col("__a"), F.col("__d") - F.col("__c")
    drawn = draw60(seed, "draw", F.col("cue_id")) % (before + after)
    place = F.when(drawn < before, F.col("__a") + drawn).otherwise(F.col("__c") + drawn - before) + 1
    wishes = asked.join(counted.filter(before + after > 0).select("cue_id", place.alias("upto")), "cue_id")
    numbered = line.filter("kind = 1").select(*keys, "upto", F.col("id").alias("control_id"), F.col("t").alias("control_ms"))
    met = wishes.join(numbered, [*keys, "upto"]).withColumn("distance_ms", F.abs(F.col("cue_ms") - F.col("control_ms")))
    first = F.min_by(F.struct("cue_id", "distance_ms"), F.struct(F.col("__n"), draw60(seed, F.col("cue_id")), F.col("cue_id")))
    return met.groupBy("control_id").agg(first.alias("c")).select("c.cue_id", "control_id", "c.distance_ms")


def _bracketed(cues: DataFrame, free: DataFrame, keys: list[str], gap: int, side: int, most: int | None = None) -> DataFrame:
    """Controls before (side -1) or after (side 1) the cues, matched like brackets: a control opens, a cue closes ``gap`` later.

    On a level of the running sum openings and closings take turns, so a cue takes the opening before it on its level, and none is left while an
    earlier control is free.
    """
    closing = cues.select(*keys, ((F.col("cue_ms") + side * gap) * -side).alias("t"), F.lit(1).alias("kind"), F.col("cue_id").alias("id"), F.col("cue_ms").alias("ms"))
    opening = free.select(*keys, (F.col("control_ms") * -side).alias("t"), F.lit(0).alias("kind"), F.col("control_id").alias("id"), F.col("control_ms").alias("ms"))
    step = F.when(F.col("kind") == 0, 1).otherwise(-1).cast("bigint")
    line = Ordered(opening.unionByName(closing), keys, ["t", "kind", "id"], most=most).running({"level": step}).done()
    line = line.withColumn("level", F.col("level") + F.col("kind"))  # the level a closing leaves, an opening reaches
    turns = Ordered(line, [*keys, "level"], ["t", "kind", "id"], most=most).neighbour(["kind", "id", "ms"], "last", -1).done()
    met = turns.filter((F.col("kind") == 1) & (F.col("last.kind") == 0))
    return met.select(F.col("id").alias("cue_id"), F.col("last.id").alias("control_id"), F.abs(F.col("ms") - F.col("last.ms")).alias("distance_ms"))


def _nearest_suitable(cues, free, keys, gap, most=None) -> DataFrame:
    """(cue_id, control_id, distance_ms, __n): nearest control at least ``gap`` away.

    Each cue is put on the time line twice, at cue_ms - gap and cue_ms + gap; the control
    carried to the first point from before and to the second from after are the two
    candidates. __n is the number of suitable controls, from the same running counts.
    """
    marks = cues.select(*keys, "cue_id", "cue_ms", F.explode(F.array(F.lit(-1), F.lit(1))).alias("side"))
    marks = marks.withColumn("t", F.col("cue_ms") + F.col("side") * gap)
    # a control at exactly the distance counts: controls sort inside the two marks' outer side
    points = marks.select(
        *keys, "t", F.when(F.col("side") < 0, 2).otherwise(0).alias("kind"),
        F.col("cue_id").alias("id"), "side", "cue_ms", F.lit(None).cast("bigint").alias("cms"))
    controls = free.select(
        *keys, F.col("control_ms").alias("t"), F.lit(1).alias("kind"), F.col("control_id").alias("id"),
        F.lit(0).alias("side"), F.lit(None).cast("bigint").alias("cue_ms"), F.col("control_ms").alias("cms"))
    held = F.when(F.col("kind") == 1, F.struct(F.col("cms"), F.col("id").alias("control_id")))
    line = (
        Ordered(points.unionByName(controls), keys, ["t", "kind", "id"], most=most)
        .carried(held, "before", -1).carried(held, "after", 1)
        .running({"upto": (F.col("kind") == 1).cast("bigint")}).done()
    )
    sizes = free.groupBy(*keys).agg(F.count(F.lit(1)).alias("__all"))
    sided = line.filter(F.col("side") != 0).join(sizes, keys).select(
        *keys, F.col("id").alias("cue_id"), "cue_ms",
        F.when(F.col("side") < 0, F.col("before")).otherwise(F.col("after")).alias("w"),
        F.when(F.col("side") < 0, F.col("upto")).otherwise(F.col("__all") - F.col("upto")).alias("n"))
    found = sided.groupBy("cue_id").agg(
        F.sum("n").alias("__n"),
        F.min_by(F.struct("w.control_id", F.abs(F.col("cue_ms") - F.col("w.cms")).alias("distance_ms")),
                 F.when(F.col("w").isNotNull(), F.struct(F.abs(F.col("cue_ms") - F.col("w.cms")), F.col("w.control_id")))).alias("b"))
    return found.filter(F.col("b.control_id").isNotNull()).select("cue_id", "b.control_id", "b.distance_ms", "__n")


def require_same_anchors(expected: DataFrame, matched: DataFrame, id_column: str) -> DataFrame:
    """Ids in only one of the two anchor sets, with the side that lacks them."""
    a, b = expected.select(id_column).distinct(), matched.select(id_column).distinct()
    return a.exceptAll(b).withColumn("missing_in", F.lit("matched")).unionByName(
        b.exceptAll(a).withColumn("missing_in", F.lit("expected"))
    )


def resolve_modes(control: str | None, anchor: str | None, default: str = "strict") -> tuple[str, str]:
    """(anchor mode, control mode); a mode given on one side only fills both."""
    anchor = "coarse" if anchor == "all" else anchor
    known = {"coarse", "strict", "very_strict", "neg", None}
    if control not in known or anchor not in known:
        raise ValueError(f"unknown selection mode {control!r} / {anchor!r}")
    return anchor or control or default, control or anchor or default


def balanced_sample(df: DataFrame, k: int, *, label: str, id_column: str, seed: int = 42, excluded: DataFrame | None = None) -> DataFrame:
    """``k`` rows, half per label, in md5 order, without the excluded ids."""
    if excluded is not None:
        df = df.join(excluded.select(id_column), id_column, "left_anti")
    return hashed_rank(df, [label], id_column, seed, "__rank").filter(F.col("__rank") <= k // 2).drop("__rank")


def corpus_split(df: DataFrame, *, id_column: str, share: float = 0.1, seed: int = 42) -> DataFrame:
    """Add ``split``: the first tenth in md5 order (at least one row) is validation."""
    ranked = with_group_size(hashed_rank(df, [], id_column, seed, "__rank"), [], "__n")
    take = F.greatest(F.lit(1), F.floor(F.lit(share) * F.col("__n")))
    return ranked.withColumn(
        "split", F.when(F.col("__rank") <= take, "validation").otherwise("train")
    ).drop("__rank", "__n")


def subsample_uniform(df: DataFrame, keys: list[str], order: list[str], limit: int) -> DataFrame:
    """At most ``limit`` rows per key, evenly spread over the key's order.

    Kept positions are rint(i (n-1) / (limit-1)); a row decides on its own whether it is one,
    by looking at the two nearest i, so no position list is built.
    """
    rows = with_group_size(Ordered(df, keys, order).numbered("__rn").done(), keys, "__n")
    at = F.col("__rn") - 1
    if limit == 1:
        keep = (F.col("__n") <= 1) | (at == F.floor(F.col("__n") / 2))
    else:
        i = F.floor(at * (limit - 1) / (F.col("__n") - 1))
        hit = F.lit(False)
        for step in (-1, 0, 1, 2):
            candidate = i + step
            inside = (candidate >= 0) & (candidate <= limit - 1)
            hit = hit | (inside & (half_even(candidate * (F.col("__n") - 1) / F.lit(float(limit - 1))) == at))
        keep = (F.col("__n") <= limit) | hit
    return rows.filter(keep).drop("__rn", "__n")
