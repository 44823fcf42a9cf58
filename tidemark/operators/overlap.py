"""Fingerprints of token streams, winnowing, candidate pairs, confirmed spans, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHINGLE, WINNOW = 8, 25
POOL = 1024


def shingles(tokens: DataFrame, k: int = SHINGLE, group: str = "grp", place: str = "pos", token: str = "token") -> DataFrame:
    """``grp, pos, digest``: SHA-256 of every k successive tokens, joined by a newline."""
    w = Window.partitionBy(group).orderBy(place).rowsBetween(0, k - 1)
    t = F.collect_list(token).over(w)
    return tokens.withColumn("_t", t).filter(F.size("_t") == k).select(F.col(group).alias("grp"), F.col(place).alias("pos"), F.sha2(F.array_join("_t", "\n"), 256).alias("digest"))


def winnow(digests: DataFrame, window: int = WINNOW) -> DataFrame:
    """Rightmost smallest digest of every ``window`` successive ones, once per place it is chosen at.

    A group with fewer digests than the window keeps its smallest.
    """
    w = Window.partitionBy("grp").orderBy("pos")
    n = F.count("*").over(Window.partitionBy("grp"))
    frame = w.rowsBetween(-(window - 1), 0)
    d = digests.withColumn("_rn", F.row_number().over(w)).withColumn("_n", n)
    d = d.withColumn("_m", F.min(F.struct("digest", (-F.col("pos")).alias("neg"))).over(frame)).filter((F.col("_rn") >= window) | ((F.col("_n") < window) & (F.col("_rn") == F.col("_n"))))
    return d.select("grp", (-F.col("_m.neg")).alias("pos"), F.col("_m.digest").alias("digest")).distinct()


def fingerprint_pairs(prints: DataFrame, most: int | None = None) -> DataFrame:
    """All pairs of equal fingerprints in two groups, however many there are.

    Fingerprints are made unique first and digests of a single group are dropped by a
    map-side aggregate. Groups that share a digest are paired first (each such pair is in
    the result, so salting the groups of a frequent digest costs less than its pairs);
    their places follow in pools of about POOL, and pools are spread before they are laid
    out, so no digest or group is one task. With ``most``, more pairs than that are an
    error; they are counted before any are made.
    """
    p = prints.select("digest", "grp", "pos").distinct()
    shared = p.groupBy("digest").agg(F.min("grp").alias("a"), F.max("grp").alias("z")).filter("a < z").select("digest")
    p = p.join(shared, "digest", "left_semi")
    groups = p.filter("grp is not null").groupBy("digest", "grp").agg(F.count("*").alias("n"))
    if most is not None:
        n = F.col("n").cast("decimal(38,0)")
        per = groups.groupBy("digest").agg(((F.sum(n) * F.sum(n) - F.sum(n * n)) / 2).alias("pairs"))
        due = per.agg(F.sum("pairs")).first()[0] or 0
        if due > most:
            raise ValueError(f"{due:.0f} pairs; the budget is {most}")
    salts = groups.groupBy("digest").agg(F.ceil(F.count("*") / F.lit(POOL)).cast("int").alias("salts"))
    groups = groups.join(salts, "digest")
    a = groups.select("digest", F.col("grp").alias("grp_a"), F.pmod(F.xxhash64("grp"), "salts").cast("int").alias("salt"))
    b = groups.select("digest", F.col("grp").alias("grp_b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    pairs = a.join(b, ["digest", "salt"]).filter("grp_a < grp_b").drop("salt")
    chunk = F.pmod(F.xxhash64("pos"), F.ceil(F.col("n") / F.lit(POOL)))
    pools = p.join(groups.select("digest", "grp", "n"), ["digest", "grp"]).groupBy("digest", "grp", chunk.alias("chunk")).agg(F.collect_list(F.struct("pos")).alias("places"))
    side = lambda s: pools.select("digest", F.col("grp").alias(f"grp_{s}"), F.col("chunk").alias(f"chunk_{s}"), F.col("places").alias(f"places_{s}"))
    cells = pairs.join(side("a"), ["digest", "grp_a"]).join(side("b"), ["digest", "grp_b"]).repartition("digest", "grp_a", "chunk_a", "grp_b", "chunk_b")
    laid = cells.withColumn("at_a", F.explode("places_a")).withColumn("at_b", F.explode("places_b"))
    return laid.select("digest", "grp_a", F.col("at_a.pos").alias("pos_a"), "grp_b", F.col("at_b.pos").alias("pos_b"))


def confirmed_spans(tokens: DataFrame, pairs: DataFrame, least: int = 32, reach: int = 24, k: int = SHINGLE) -> DataFrame:
    """Seeds grown by up to ``reach`` equal rows to each side; kept if they come to ``least`` equal rows.

    Seeds on one diagonal that grow into the same rows give one span.
    """
    seeds = pairs.select("grp_a", "grp_b", "pos_a", "pos_b").distinct()
    s = seeds.withColumn("shift", F.explode(F.sequence(F.lit(-reach), F.lit(reach + k - 1))))
    a = tokens.select(F.col("grp").alias("grp_a"), F.col("pos").alias("at_a"), F.col("token").alias("ta"))
    b = tokens.select(F.col("grp").alias("grp_b"), F.col("pos").alias("at_b"), F.col("token").alias("tb"))
    s = s.withColumns({"at_a": F.col("pos_a") + F.col("shift"), "at_b": F.col("pos_b") + F.col("shift")}).join(a, ["grp_a", "at_a"]).join(b, ["grp_b", "at_b"]).filter("ta = tb")
    line = Window.partitionBy("grp_a", "grp_b", "pos_a", "pos_b").orderBy("shift")
    s = s.withColumn("isle", F.col("shift") - F.row_number().over(line))
    runs = s.groupBy("grp_a", "grp_b", "pos_a", "pos_b", "isle").agg(F.min("shift").alias("lo"), F.max("shift").alias("hi")).filter("lo <= 0 and hi >= 0").filter(F.col("hi") - F.col("lo") + 1 >= least)
    return runs.select("grp_a", (F.col("pos_a") + F.col("lo")).alias("start_a"), "grp_b", (F.col("pos_b") + F.col("lo")).alias("start_b"), (F.col("hi") - F.col("lo") + 1).cast("long").alias("n_rows")).distinct()


def content_classes(df: DataFrame, key: str, content: Column) -> DataFrame:
    """``key, class_key, n_members``: rows of equal content share the smallest key, copies are not paired."""
    h = df.select(F.col(key).alias("id"), content.alias("content"))
    classes = h.filter("content is not null").groupBy("content").agg(F.min("id").alias("class_key"), F.count_distinct("id").alias("n_members"))
    return h.join(classes, "content").select(F.col("id").alias(key), "class_key", "n_members").distinct()


def _signed(k: int):
    return lambda x, i: x * F.when(F.xxhash64(i, F.lit(k)) % 2 == 0, 1.0).otherwise(-1.0)


def near_duplicates(vectors: DataFrame, key: str, values: str, min_r: float = 0.999999, max_nrmse: float = 1e-5, least: int = 64, digits: int = 3) -> DataFrame:
    """Pairs of class representatives whose vectors are almost equal, exact copies left to ``content_classes``.

    Blocking loses nothing within the bound: near copies have root mean squares in the same
    or the next logarithmic bin, and their projections on three fixed directions differ by
    no more than their distance, so cells of twice that width with each vector also sent to
    the cells half a width away bring every such pair together.
    """
    v = vectors.select(F.col(key).alias("id"), F.transform(values, lambda x: x.cast("double")).alias("v")).filter("v is not null")
    rep = v.groupBy("v").agg(F.min("id").alias("id"))
    dot = lambda f: F.aggregate(F.col("v"), F.lit(0.0), lambda acc, x: acc + f(x))
    n = F.size("v")
    rep = rep.withColumn("rms", F.sqrt(dot(lambda x: x * x) / n)).filter(n >= least)
    width = 4 * max_nrmse
    at = F.floor(F.ln(F.greatest("rms", F.lit(1e-300))) / width)
    # unit directions with signs from a hash of the place: |direction . (x - y)| <= |x - y|
    for k in range(3):
        terms = F.transform("v", _signed(k))
        rep = rep.withColumn(f"p{k}", F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x) / F.sqrt(n))
    reach = lambda b: max_nrmse * F.sqrt(n) * F.exp((b + 2) * F.lit(width))  # noqa: E731  largest distance of a near pair of bin b
    a = rep.withColumn("bin", at)
    a = a.withColumns({f"c{k}": F.floor(F.col(f"p{k}") / (2 * reach(F.col("bin")))) for k in range(3)})
    b = rep.withColumn("bin", F.explode(F.array(at - 1, at, at + 1)))
    for k in range(3):
        r = reach(F.col("bin"))
        b = b.withColumn(f"c{k}", F.explode(F.array_distinct(F.array(F.floor((F.col(f"p{k}") - r) / (2 * r)), F.floor((F.col(f"p{k}") + r) / (2 * r))))))
    cell = ["bin", "c0", "c1", "c2"]
    b = b.select(F.col("id").alias("id_b"), F.col("v").alias("w"), *cell)
    p = a.join(b, cell).filter((F.col("id") < F.col("id_b")) & (F.size("v") == F.size("w"))).dropDuplicates(["id", "id_b"])
    z = F.zip_with("v", "w", lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    tot = lambda f: F.aggregate(z, F.lit(0.0), lambda acc, q: acc + f(q["x"], q["y"]))
    sx, sy, sxy, sxx, syy, sd = (tot(f) for f in (lambda x, y: x, lambda x, y: y, lambda x, y: x * y, lambda x, y: x * x, lambda x, y: y * y, lambda x, y: (x - y) * (x - y)))
    p = p.select("id", "id_b", n.alias("n"), sx.alias("sx"), sy.alias("sy"), sxy.alias("sxy"), sxx.alias("sxx"), syy.alias("syy"), sd.alias("sd"))
    vx, vy = F.col("sxx") - F.col("sx") ** 2 / F.col("n"), F.col("syy") - F.col("sy") ** 2 / F.col("n")
    p = p.withColumn("r", F.when((vx > 0) & (vy > 0), (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / F.sqrt(vx * vy)))
    p = p.withColumn("nrmse", F.sqrt(F.col("sd") / F.col("n")) / F.greatest(F.sqrt((F.col("sxx") + F.col("syy")) / 2 / F.col("n")), F.lit(1e-300)))
    return p.filter((F.col("r") >= min_r) & (F.col("nrmse") <= max_nrmse)).select(F.col("id").alias("id_a"), "id_b", "r", "nrmse")


def source_spans(groups: DataFrame) -> DataFrame:
    """Half-open span of each fragment's rows in its group, from running totals: ``grp, fragment, lo, hi``."""
    w = Window.partitionBy("grp").orderBy("fragment").rowsBetween(Window.unboundedPreceding, 0)
    return groups.withColumn("hi", F.sum("n_rows").over(w)).withColumn("lo", F.col("hi") - F.col("n_rows")).select("grp", "fragment", "lo", "hi")
