"""End-to-end tracking: footprints and features in, cluster identities and their quality out."""

from __future__ import annotations

import argparse
import json
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import config
from tessera.operators import calibrate, graph, ids, overlap, quality, search, similarity, spatial
from tessera.operators.checkpoints import cut, stored

DEFAULTS: dict = {
    "frame": {"height": 512, "width": 512},
    "blur": {"half_width": 0},
    "similarity": {"mask_power": 1.0},
    "normalization": {"k_max": 100, "k_min": 10},
    "mixing": {"method": "automatic", "n_bins": None, "window": None, "sample": search.SAMPLE_ROWS, "generations": 40, "powers": {"sf": 1.0, "nn": 0.5, "swt": 0.5}, "p_norm": -1.0, "sigmoid": {"mu": 0.5, "b": 1.0}, "seed": 0},
    "pruning": {"stringency": 1.0, "d_cutoff": None, "probability": False},
    "clustering": {"method": "automatic", "switch": 6, "min_size": 2, "max_size": None, "min_samples": None, "leaf": False, "rescue": True, "thresh_cost": 0.6},
}


@dataclass
class Tracked:
    """Labels, the pruned edges, and all edges' similarities ``i, j, s``, from which the quality is found when it is asked for."""

    labels: DataFrame
    edges: DataFrame
    sims: DataFrame
    params: dict = field(default_factory=dict)
    anew: bool = False

    @cached_property
    def quality(self) -> tuple[DataFrame, DataFrame]:
        return quality.quality_report(stored(self.sims) if self.anew else self.sims, self.labels)

    @property
    def clusters(self) -> DataFrame:
        return self.quality[0]

    @property
    def samples(self) -> DataFrame:
        return self.quality[1]

    def save(self, root: str) -> None:
        """Labels, edges and quality as Parquet, the parameters as JSON."""
        from tessera.sources.files import Archive

        Archive(self.labels.sparkSession, root).save({"labels": self.labels, "edges": self.edges, "clusters": self.clusters, "samples": self.samples}, self.params)


def similarity_graph(footprint: DataFrame, roi: DataFrame, features: dict[str, DataFrame], params: dict) -> DataFrame:
    """``i, j, s_sf, s_<feature>..., inter``, directed: pairs whose footprints overlap, then their features' z-scores.

    All of an edge is found where the blocks of its ends meet, each time the edges are read. If ids
    repeat or a session or vector is missing, it is put together by joins, and kept.
    """
    half_width, power = params["blur"]["half_width"], params["similarity"]["mask_power"]
    if half_width:
        rows = overlap.unpack(footprint).withColumn("session_id", F.lit(0)) if overlap.is_packed(footprint) else footprint
        footprint = spatial.blur(rows, half_width, params["frame"]["height"], params["frame"]["width"])
    packed = footprint if overlap.is_packed(footprint) else cut(overlap.pack(footprint))
    n = roi.select(F.countDistinct("session_id")).first()[0]
    donut = cut(similarity.knn_donut(roi, n * params["normalization"]["k_min"], n * params["normalization"]["k_max"])) if features else None
    scored = bool(features) and not donut.isEmpty()
    if overlap.one_row_each(roi, features):
        objects = roi.select(F.col("roi_id").cast("long").alias("roi_id"), "session_id", F.lit(True).alias("scored"))
        for name, vectors in features.items():
            objects = overlap.vector_columns(objects, vectors, similarity.donut_stats(donut, vectors) if scored else None, name)
        return overlap.overlap_edges(packed, cut(objects), list(features), power)
    edges = similarity.footprint_similarity(overlap.unpack(packed), power, directed=True).withColumnRenamed("s", "s_sf")
    edges = stored(similarity.inter_session(edges, roi))
    for name, vectors in features.items():
        raw = similarity.masked_cosine(edges, vectors, f"s_{name}")
        edges = similarity.zscore(raw, similarity.donut_stats(donut, vectors), f"s_{name}", f"s_{name}") if scored else raw
    return stored(edges)


def mixing(edges: DataFrame, names: list[str], params: dict, bins: int, window: int) -> tuple[dict[str, dict], float]:
    """Each metric's sigmoid and power, and the order of the power mean."""
    m = params["mixing"]
    if m["method"] == "manual" or edges.where("NOT inter").isEmpty():
        return {f"s_{k}": ({} if k == "sf" else dict(m["sigmoid"])) | {"power": m["powers"].get(k, 1.0)} for k in names}, m["p_norm"]
    sigmoid = {}
    for k in names:
        best = calibrate.fisher_sigmoid(calibrate.same_diff_bins(edges, f"s_{k}", bins, window), bins).first()
        sigmoid[f"s_{k}"] = (best["mu"], best["b"])
    found = search.mixing_search(edges, sigmoid, bins, window, m["sample"], m["seed"], generations=m["generations"])
    return {k: {"mu": sigmoid[k][0], "b": sigmoid[k][1], "power": p} for k, p in found["powers"].items()}, found["p_norm"]


def track(footprint: DataFrame, roi: DataFrame, features: dict[str, DataFrame] | None = None, params: dict | None = None) -> Tracked:
    """``footprint(roi_id, session_id, pixel, weight)``, ``roi(roi_id, session_id, cy, cx)``, ``features``: name -> ``(roi_id, vec)``.

    ``footprint`` may also be an ``overlap.pack``. With powers and cutoff given, one pass over the
    edges finds the pruned ones, and the others are never written; what is to be fitted takes more
    passes, for which the edges are written once.
    """
    params = config.prepare(params or {}, DEFAULTS)
    features = features or {}
    edges = similarity_graph(footprint, roi, features, params)
    prune, m = params["pruning"], params["mixing"]
    anew = m["method"] == "manual" and prune["d_cutoff"] is not None and not prune["probability"]
    bins = window = 0
    if not anew:
        edges = stored(edges)
        bins, window = calibrate.default_bins(edges.count())
        bins, window = m["n_bins"] or bins, m["window"] or window
    settings, p = mixing(edges, ["sf", *features], params, bins, window)
    mixed = calibrate.conjunctive(edges, settings, p)
    if prune["probability"]:
        table = calibrate.monotone_probability(calibrate.same_diff_bins(mixed, "d", bins, window, 0.0, 1.0), bins, window)
        mixed = calibrate.to_probability(mixed, [r["p"] for r in table.orderBy("bin").collect()])
    cutoff = prune["d_cutoff"]
    if cutoff is None:
        cross, least = calibrate.crossover(mixed, bins, window).first()["d_crossover"], mixed.agg(F.min("d")).first()[0]
        cutoff = 1.0 if cross is None or least is None else least + (cross - least) * prune["stringency"]
    pruned = cut(calibrate.prune(mixed, d_cutoff=cutoff))
    c = params["clustering"]
    sessions = roi.select(F.countDistinct("session_id")).first()[0]
    method = graph.choose_method(sessions, c["switch"]) if c["method"] == "automatic" else c["method"]
    if method == "density":
        labels = graph.fit(pruned, roi, cutoff, c["min_size"], c["max_size"], c["min_samples"], c["leaf"], c["rescue"])
    else:
        labels = graph.sequential_assignment(pruned, roi, c["thresh_cost"])[0].join(roi.select("roi_id", "session_id"), "roi_id")
    labels = cut(labels)
    sims = mixed.select("i", "j", F.col("sim").alias("s"))
    return Tracked(labels, pruned, sims, params | {"fitted": {"metrics": settings, "p_norm": p, "d_cutoff": cutoff, "method": method}}, anew)


def good_samples(tracked: Tracked, cluster_silhouette: float = 0.2, sample_silhouette: float = 0.1) -> DataFrame:
    """Objects of clusters above both bounds of quality."""
    good = tracked.clusters.where(F.col("silhouette") > cluster_silhouette).select("label")
    return tracked.samples.where(F.col("silhouette") > sample_silhouette).join(good, "label", "left_semi")


def align_traces(tracked: Tracked, values: DataFrame, roi: DataFrame, min_sessions: int | str = 2) -> DataFrame:
    """Per-object values laid out by cluster identity, identities of few sessions left out."""
    labels = tracked.labels.join(roi.select("roi_id", "roi_idx"), "roi_id").select("session_id", "roi_idx", F.col("label").cast("bigint").alias("ucid"))
    return ids.align(ids.squeeze_ucids(ids.discard_rare(labels, min_sessions)), values)


def main(argv: list[str] | None = None) -> None:
    """``python -m tessera.pipeline --input DIR --output DIR [--params FILE.json]``."""
    parser = argparse.ArgumentParser(description=main.__doc__)
    parser.add_argument("--input", required=True, help="folder with footprint, roi and, per feature, latent_<name> as Parquet")
    parser.add_argument("--output", required=True)
    parser.add_argument("--params")
    parser.add_argument("--features", default="", help="names, comma-joined")
    args = parser.parse_args(argv)
    params = json.load(open(args.params)) if args.params else {}
    spark = SparkSession.builder.appName("tracking").getOrCreate()
    read = lambda name: spark.read.parquet(f"{args.input}/{name}")
    names = [n for n in args.features.split(",") if n]
    track(read("footprint"), read("roi"), {n: read(f"latent_{n}") for n in names}, params).save(args.output)


if __name__ == "__main__":
    main()
