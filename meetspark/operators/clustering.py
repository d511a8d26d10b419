"""Speaker embeddings: normalisation, clusters, galleries and the matching of ids."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import clip_turn_overlaps, covered_sec, merge_turns, speaker_at
from .lineage import stored
from .running import running

_PART_IDS = 1 << 31


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(_dot(v, v))


def l2_normalize(v: Column) -> Column:
    """Unit vector; the norm counts as 1e-12 at least."""
    return F.transform(v, lambda x: x.cast("double") / F.greatest(norm(v), F.lit(1e-12)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n > 0, _dot(a, b) / n).otherwise(0.0)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1.0 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(a, b)))


def average_linkage(vectors: np.ndarray, threshold: float, sizes: np.ndarray | None = None) -> np.ndarray:
    """Labels by first appearance of average-linkage clusters under cosine distance; merging stops at ``threshold``.

    The mean distance between two clusters is one less the product of the means of their unit vectors, so a cluster is its mean and
    size, and no matrix of distances is held. A chain of nearest neighbours is followed until two are each other's nearest; they
    merge, or if they are too far apart never will. Work is quadratic. With ``sizes`` the rows are means of that many unit vectors.
    """
    n = len(vectors)
    mean = np.array(vectors, dtype=float)
    if sizes is None:
        mean /= np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)
    size, label, alive = np.ones(n) if sizes is None else np.array(sizes, dtype=float), np.arange(n), np.ones(n, dtype=bool)
    chain: list[int] = []
    start = 0
    while True:
        if not chain:
            while start < n and not alive[start]:
                start += 1
            if start == n:
                break
            chain.append(start)
        c = chain[-1]
        far = np.where(alive, 1 - mean @ mean[c], np.inf)
        far[c] = np.inf
        near = int(np.argmin(far))
        if len(chain) > 1 and far[chain[-2]] <= far[near]:
            near = chain[-2]
        if far[near] >= threshold:
            alive[c] = False
            chain.pop()
        elif len(chain) > 1 and near == chain[-2]:
            i, j = sorted((c, near))
            mean[i] = (mean[i] * size[i] + mean[j] * size[j]) / (size[i] + size[j])
            size[i] += size[j]
            label[label == j] = i
            alive[j] = False
            del chain[-2:]
        else:
            chain.append(near)
    return pd.factorize(label)[0].astype(np.int64)


def _nearest(rows: DataFrame, threshold: float, most: int) -> DataFrame:
    """``job_id, id, near`` of ``rows(job_id, id, mean, live)``: the nearest other cluster of the job under ``threshold``; ties go to the least id.

    A job's clusters are dealt into blocks by id; each task compares two blocks, about ``most`` rows, and passes on one row for a
    cluster at most, so neither a job nor its pairs ever come together.
    """
    dealt = rows.withColumn("blocks", F.ceil(F.col("live") / max(1, most // 2))).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select("job_id", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "id", "mean")

    def two(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        ids, mean, low = rows.id.to_numpy(), np.stack(rows["mean"].to_numpy()), (rows.own == rows.lo).to_numpy()
        if rows.lo.iloc[0] == rows.hi.iloc[0]:
            far = np.round(1 - mean @ mean.T, 12)
            far = np.minimum(far, far.T)
            np.fill_diagonal(far, np.inf)
            found = [(ids, ids, far)]
        else:
            far = np.round(1 - mean[low] @ mean[~low].T, 12)
            if not far.size:  # an empty block
                return pd.DataFrame(columns=["job_id", "id", "near", "far"])
            found = [(ids[low], ids[~low], far), (ids[~low], ids[low], far.T)]
        out = pd.concat([pd.DataFrame({"id": of, "near": to[far.argmin(axis=1)], "far": far.min(axis=1)}) for of, to, far in found])
        return out[out.far < threshold].assign(job_id=rows.job_id.iloc[0])[["job_id", "id", "near", "far"]]

    pairs = met.groupBy("job_id", "lo", "hi").applyInPandas(two, "job_id long, id long, near long, far double")
    return pairs.groupBy("job_id", "id").agg(F.min(F.struct("far", "near"))["near"].alias("near"))


def merge_alike(clusters: DataFrame, threshold: float, most: int = 4000) -> tuple[DataFrame, int]:
    """``job_id, id, root`` of ``clusters(job_id, id, n, mean)``: average linkage of a job's clusters, ``root`` the least id of each result; and
    the number of rounds it took.

    A job of up to ``most`` clusters is one group. Others go through rounds: all pairs of clusters that are each other's nearest merge at
    once, which for average linkage gives what merging one pair at a time gives, and a cluster without another under ``threshold`` is
    finished, as mean distances to what others merge into lie beyond it too. So a job where nothing is alike takes one
    round, and one with at most ``most`` clusters left is one group again.
    """
    roots, live, rounds = clusters.select("job_id", "id", F.col("id").alias("root")), clusters, 0
    while True:
        sizes = live.groupBy("job_id").agg(F.count("*").alias("live"))
        if sizes.filter(F.col("live") > most).isEmpty():
            break
        rounds += 1
        sized = live.join(sizes, "job_id")
        crowded = sized.filter(F.col("live") > most)
        near = stored(_nearest(crowded, threshold, most), "near")
        mutual = near.join(near.select("job_id", F.col("near").alias("id"), F.col("id").alias("near")), ["job_id", "id", "near"], "left_semi")
        pairs = mutual.filter("id < near").select("job_id", F.col("near").alias("gone"), F.col("id").alias("keep"))
        going = crowded.join(near, ["job_id", "id"], "left_semi").join(pairs.withColumnRenamed("gone", "id"), ["job_id", "id"], "left")
        sides = F.array_sort(F.collect_list(F.struct("id", "n", "mean")))  # one cluster, or two that merge
        going = going.groupBy("job_id", F.coalesce("keep", "id").alias("id")).agg(sides[0].alias("a"), F.get(sides, F.lit(1)).alias("b"))
        mixed = F.zip_with("a.mean", "b.mean", lambda x, y: (x * F.col("a.n") + y * F.col("b.n")) / (F.col("a.n") + F.col("b.n")))
        going = going.select("job_id", "id", (F.col("a.n") + F.coalesce("b.n", F.lit(0))).alias("n"), F.coalesce(mixed, F.col("a.mean")).alias("mean"))
        live = stored(sized.filter(F.col("live") <= most).drop("live").unionByName(going), "live")
        roots = stored(roots.join(pairs.withColumnRenamed("gone", "root"), ["job_id", "root"], "left").select("job_id", "id", F.coalesce("keep", "root").alias("root")), "roots")

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id").reset_index(drop=True)
        label = average_linkage(np.stack(rows["mean"].to_numpy()), threshold, rows.n.to_numpy())
        return pd.DataFrame({"job_id": rows.job_id, "root": rows.id, "top": rows.id.groupby(label).transform("min")})

    last = live.groupBy("job_id").applyInPandas(one, "job_id long, root long, top long")
    if rounds == 0:
        return last.select("job_id", F.col("root").alias("id"), F.col("top").alias("root")), rounds
    return roots.join(last, ["job_id", "root"], "left").select("job_id", "id", F.coalesce("top", "root").alias("root")), rounds


def cluster_windows(df: DataFrame, threshold: float = 0.85, part: int = 2000, most: int = 4000) -> DataFrame:
    """``job_id, ord, label`` of ``df(job_id, ord, embedding)``; labels count from 0 by first appearance.

    A task clusters a part of ``part`` ords of a job, whatever the job's length. The parts' clusters, as means and sizes, are then
    merged by job in the same way (``merge_alike``): for a job of one part this changes nothing, and for others it merges by the true mean
    distances between the parts' clusters. No task holds more than a part, or about ``most`` clusters.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ord").reset_index(drop=True)
        unit = np.stack(rows.embedding.to_numpy()).astype(float)
        unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-12)
        label = average_linkage(unit, threshold)
        n = np.bincount(label)
        first = np.unique(label, return_index=True)[1]
        mean: list[list[float] | None] = [None] * len(rows)
        for i, at in enumerate(first):
            mean[at] = unit[label == i].mean(axis=0).tolist()
        # ids of clusters: parts in order, then labels by first appearance
        return pd.DataFrame({"job_id": rows.job_id, "ord": rows.ord, "id": rows.part * _PART_IDS + label, "n": n[label], "mean": mean})

    keyed = df.select("job_id", F.col("ord").cast("long").alias("ord"), F.expr(f"cast(ord as bigint) div {part}").alias("part"), "embedding")
    parts = stored(keyed.groupBy("job_id", "part").applyInPandas(one, "job_id long, ord long, id long, n long, mean array<double>"), "parts")
    roots, rounds = merge_alike(parts.filter("mean IS NOT NULL").select("job_id", "id", "n", "mean"), threshold, most)
    if rounds == 0:  # no job has more than ``most`` clusters
        whole = roots.withColumn("label", F.dense_rank().over(Window.partitionBy("job_id").orderBy("root")))
    else:
        roots = stored(roots, "roots")
        whole = roots.join(running(roots.select("job_id", "root").distinct(), ["root"], {"label": ("sum", F.lit(1))}, at="root", width=float(_PART_IDS)), ["job_id", "root"])
    return parts.select("job_id", "ord", "id").join(whole, ["job_id", "id"]).select("job_id", "ord", (F.col("label") - 1).cast("long").alias("label"))


def renumber_speakers(df: DataFrame) -> DataFrame:
    """Dense ids by first appearance."""
    first = F.min("ord").over(Window.partitionBy("job_id", "speaker"))
    ranked = df.withColumn("first", first).withColumn("n", F.dense_rank().over(Window.partitionBy("job_id").orderBy("first")) - 1)
    return ranked.select("job_id", "ord", F.format_string("SPEAKER_%02d", "n").alias("speaker"))


def speaker_centroids(df: DataFrame) -> DataFrame:
    """Unit mean of the unit vectors of each speaker. Vectors are split by place, so partial averages are made map-side."""
    spread = df.select("job_id", "speaker", F.posexplode(l2_normalize(F.col("embedding"))).alias("pos", "x"))
    mean = spread.groupBy("job_id", "speaker", "pos").agg(F.avg("x").alias("x"))
    vec = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"])
    counts = df.groupBy("job_id", "speaker").agg(F.count("*").alias("n_windows"))
    return mean.groupBy("job_id", "speaker").agg(vec.alias("v")).select("job_id", "speaker", l2_normalize(F.col("v")).alias("centroid")).join(counts, ["job_id", "speaker"])


def assign_to_gallery(windows: DataFrame, gallery: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Nearest speaker of the job's gallery for each window; null beyond ``threshold``. ``job_id`` is the equality key.

    A job without a gallery has no rows. ``update_gallery`` names the rest and blends the gallery.
    """
    g = gallery.select("job_id", F.col("speaker").alias("near"), "centroid")
    far = windows.join(g, "job_id").select("job_id", "ord", "near", F.round(cosine_distance(F.col("embedding"), F.col("centroid")), 9).alias("d"))
    best = far.groupBy("job_id", "ord").agg(F.min(F.struct("d", "near")).alias("b"))
    return best.select("job_id", "ord", F.when(F.col("b.d") <= threshold, F.col("b.near")).alias("speaker"), F.round("b.d", 6).alias("distance"))


def update_gallery(windows: DataFrame, gallery: DataFrame, threshold: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """One batch of windows against ``gallery(job_id, speaker, n_windows, centroid)``: ``job_id, ord, speaker``, and the gallery after it.

    Windows within ``threshold`` take their nearest speaker; the others are clustered among themselves into the lowest free ids. Then each
    speaker's centroid is the count-weighted blend of the old one and the mean of its windows, made a unit vector again.
    """
    near = windows.select("job_id", "ord").join(assign_to_gallery(windows, gallery, threshold).select("job_id", "ord", "speaker"), ["job_id", "ord"], "left")
    rest = windows.join(near.filter("speaker IS NULL").select("job_id", "ord"), ["job_id", "ord"], "left_semi")
    made = cluster_windows(rest, threshold).withColumn("cluster", F.col("label").cast("string"))
    names = _with_free_ids(made.select("job_id", "cluster").distinct(), gallery.select("job_id", "speaker"))
    assigned = near.filter("speaker IS NOT NULL").unionByName(made.join(names, ["job_id", "cluster"]).select("job_id", "ord", "speaker"))
    return assigned, _blended(gallery, windows, assigned)


def _blended(gallery: DataFrame, windows: DataFrame, assigned: DataFrame, keep_counts: bool = False) -> DataFrame:
    """The gallery after a batch: centroids blended by count with the means of the windows; new speakers as they are. With ``keep_counts``
    the numbers of windows stay those of before."""
    heard = speaker_centroids(windows.select("job_id", "ord", "embedding").join(assigned.select("job_id", "ord", "speaker"), ["job_id", "ord"])).select("job_id", "speaker", F.col("n_windows").alias("m"), F.col("centroid").alias("v"))
    met = gallery.select("job_id", "speaker", F.col("n_windows").cast("long").alias("n"), F.col("centroid").alias("c")).join(heard, ["job_id", "speaker"], "full")
    blend = l2_normalize(F.zip_with("c", "v", lambda x, y: x * F.col("n") + y * F.col("m")))
    count = F.coalesce("n", F.lit(0)) if keep_counts else F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))
    return met.select("job_id", "speaker", count.alias("n_windows"), F.when(F.col("v").isNull(), F.col("c")).when(F.coalesce("n", F.lit(0)) <= 0, F.col("v")).otherwise(blend).alias("centroid"))


def refine_reassign(windows: DataFrame, gallery: DataFrame, threshold: float = 0.85) -> DataFrame:
    """``job_id, ord, speaker`` in two passes: windows near the gallery move its centroids, and all are assigned anew to those; what is left
    is clustered into the lowest free ids."""
    near = assign_to_gallery(windows, gallery, threshold).filter("speaker IS NOT NULL")
    return update_gallery(windows, _blended(gallery, windows, near, keep_counts=True), threshold)[0]


def clear_winner(windows: DataFrame, gallery: DataFrame, threshold: float = 0.85, margin: float = 0.05, short: float = 2.0) -> DataFrame:
    """``job_id, ord, speaker``: windows are clustered first; a cluster takes its nearest speaker of the gallery if that is within ``threshold`` and
    nearer by ``margin`` than the next, or if the cluster has less than ``short`` seconds of speech; else it gets a free id."""
    met = windows.select("job_id", "ord", "start", "end", "embedding").join(cluster_windows(windows, threshold), ["job_id", "ord"]).withColumn("cluster", F.col("label").cast("string"))
    means = speaker_centroids(met.withColumn("speaker", F.col("cluster"))).select("job_id", F.col("speaker").alias("cluster"), F.col("centroid").alias("v"))
    far = means.join(gallery.select("job_id", "speaker", "centroid"), "job_id", "left").select("job_id", "cluster", F.when(F.col("speaker").isNotNull(), F.struct(F.round(cosine_distance(F.col("v"), F.col("centroid")), 9).alias("d"), "speaker")).alias("x"))
    near = far.groupBy("job_id", "cluster").agg(F.array_sort(F.collect_list("x")).alias("x"))  # one entry for each speaker of the gallery
    sec = covered_sec(met.select(F.struct("job_id", "cluster").alias("job_id"), "ord", "start", "end")).select("job_id.job_id", "job_id.cluster", "covered_sec")
    first = F.get("x", F.lit(0))
    clear = (first["d"] <= threshold) & ((F.size("x") == 1) | (F.get("x", F.lit(1))["d"] - first["d"] >= margin))
    named = near.join(sec, ["job_id", "cluster"], "left").filter(clear | ((F.coalesce("covered_sec", F.lit(0.0)) < short) & (F.size("x") > 0))).select("job_id", "cluster", first["speaker"].alias("speaker"))
    rest = near.select("job_id", "cluster").join(named, ["job_id", "cluster"], "left_anti")
    return met.join(named.unionByName(_with_free_ids(rest, gallery.select("job_id", "speaker"))), ["job_id", "cluster"]).select("job_id", "ord", "speaker")


def greedy_remap(overlaps: DataFrame) -> DataFrame:
    """One-to-one matching of ``overlaps(job_id, cluster, published, sec)``, largest first; ties by names. A fold per job."""
    pairs = overlaps.filter("sec > 0").groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("sec")).alias("k"), "cluster", "published"))).alias("p"))
    kind = "array<struct<k:double,cluster:string,published:string>>"
    fold = f"aggregate(p, cast(array() AS {kind}), (a, x) -> IF(exists(a, y -> y.cluster = x.cluster OR y.published = x.published), a, concat(a, array(x))))"
    return pairs.select("job_id", F.explode(F.expr(fold)).alias("x")).select("job_id", "x.cluster", "x.published", F.round(-F.col("x.k"), 3).alias("sec"))


def absorb_micro_speakers(speakers: DataFrame, least: float = 2.0) -> DataFrame:
    """``speakers(job_id, speaker, sec, centroid)`` to ``job_id, speaker, target``: the smallest below ``least`` seconds first, into
    the nearest remaining centroid, which gains its seconds. A job has few speakers, so a group is small."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("speaker").reset_index(drop=True)
        sec, vec, target = dict(zip(rows.speaker, rows.sec)), dict(zip(rows.speaker, rows.centroid)), {s: s for s in rows.speaker}
        skipped: set[str] = set()
        while least > 0:
            small = sorted((v, s) for s, v in sec.items() if v < least and s not in skipped)
            if not small or len(sec) < 2:
                break
            s = small[0][1]
            others = [o for o in sec if o != s and vec[o] is not None]
            if vec[s] is None or not others:
                skipped.add(s)
                continue
            cos = lambda a, b: float(np.dot(a, b) / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-12))
            into = max(others, key=lambda o: (round(cos(vec[s], vec[o]), 12), o))
            sec[into] += sec.pop(s)
            target = {k: into if v == s else v for k, v in target.items()}
        return pd.DataFrame({"job_id": rows.job_id, "speaker": rows.speaker, "target": [target[s] for s in rows.speaker]})

    return speakers.groupBy("job_id").applyInPandas(one, "job_id long, speaker string, target string")


def turns_from_windows(windows: DataFrame, max_gap: float = 0.3, min_dur: float = 1.0, renumber: bool = False) -> DataFrame:
    """Windows of known speakers to turns that do not overlap; ids by first appearance if ``renumber``."""
    turns = clip_turn_overlaps(merge_turns(windows, max_gap, min_dur))
    if renumber:
        turns = turns.drop("speaker").join(renumber_speakers(turns), ["job_id", "ord"])
    return turns.select("job_id", "ord", "turn_id", "speaker", "start", "end")


def _with_free_ids(unnamed: DataFrame, taken: DataFrame) -> DataFrame:
    """``unnamed(job_id, cluster)`` with the lowest ``SPEAKER_nn`` that ``taken(job_id, speaker)`` leaves free, in order of cluster.

    A job's speakers are few, so the set of those taken is a small array.
    """
    sets = taken.filter("speaker IS NOT NULL").groupBy("job_id").agg(F.collect_set("speaker").alias("taken"))
    rank = F.row_number().over(Window.partitionBy("job_id").orderBy(F.col("cluster").cast("long"), "cluster"))
    met = unnamed.withColumn("rank", rank).join(sets, "job_id", "left").withColumn("taken", F.coalesce("taken", F.array().cast("array<string>")))
    free = F.expr("filter(transform(sequence(0, size(taken) + rank), k -> format_string('SPEAKER_%02d', k)), s -> NOT array_contains(taken, s))")
    return met.select("job_id", "cluster", F.get(free, F.col("rank") - 1).alias("speaker"))


def refine_speakers(windows: DataFrame, threshold: float = 0.85) -> DataFrame:
    """``windows(job_id, ord, start, end, embedding, speaker)`` clustered anew; clusters keep the published speakers they share most time with.

    Clusters without one get the lowest free ids. Returns ``job_id, ord, speaker``.
    """
    met = windows.select("job_id", "ord", "start", "end", F.col("speaker").alias("published")).join(cluster_windows(windows, threshold), ["job_id", "ord"]).withColumn("cluster", F.col("label").cast("string"))
    shared = met.groupBy("job_id", "cluster", "published").agg(F.sum(F.greatest(F.col("end") - F.col("start"), F.lit(0.0))).alias("sec"))
    named = greedy_remap(shared.filter("published IS NOT NULL")).select("job_id", "cluster", F.col("published").alias("speaker"))
    rest = shared.select("job_id", "cluster").distinct().join(named, ["job_id", "cluster"], "left_anti")
    names = named.unionByName(_with_free_ids(rest, windows.select("job_id", "speaker").distinct()))
    return met.join(names, ["job_id", "cluster"]).select("job_id", "ord", "speaker")


def cluster_then_match(windows: DataFrame, gallery: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Windows clustered first; each cluster's mean takes the nearest speaker of the gallery as it was before, or a free id."""
    met = windows.select("job_id", "ord", "embedding").join(cluster_windows(windows, threshold), ["job_id", "ord"]).withColumn("cluster", F.col("label").cast("string"))
    means = speaker_centroids(met.withColumn("speaker", F.col("cluster"))).select("job_id", F.col("speaker").alias("ord"), F.col("centroid").alias("embedding"))
    named = assign_to_gallery(means, gallery, threshold).filter("speaker IS NOT NULL").select("job_id", F.col("ord").alias("cluster"), "speaker")
    rest = met.select("job_id", "cluster").distinct().join(named, ["job_id", "cluster"], "left_anti")
    names = named.unionByName(_with_free_ids(rest, gallery.select("job_id", "speaker")))
    return met.join(names, ["job_id", "cluster"]).select("job_id", "ord", "speaker")


def finalize_speakers(windows: DataFrame, segments: DataFrame, threshold: float = 0.85, least: float = 2.0) -> DataFrame:
    """Speakers of the segments of finished jobs: windows refined, made into turns that name each segment by its middle, then
    speakers below ``least`` seconds of speech taken into their nearest."""
    refined = windows.drop("speaker").join(refine_speakers(windows, threshold), ["job_id", "ord"])
    middle = segments.select("job_id", "ord", "speaker", ((F.col("start") + F.col("end")) / 2).alias("mid"))
    named = speaker_at(middle, turns_from_windows(refined)).select("job_id", "ord", "speaker")
    sec = segments.select("job_id", "ord", "start", "end").join(named, ["job_id", "ord"]).groupBy("job_id", "speaker").agg(F.sum(F.col("end") - F.col("start")).alias("sec"))
    targets = absorb_micro_speakers(sec.join(speaker_centroids(refined), ["job_id", "speaker"], "left").select("job_id", "speaker", "sec", "centroid"), least)
    return named.join(targets, ["job_id", "speaker"]).select("job_id", "ord", F.col("target").alias("speaker"))
