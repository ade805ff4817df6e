"""Quality from a document's own text and from its site, by hierarchical empirical Bayes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import free_name, saved
from .textmodel import TextModel

LEAST_PROBABILITY = 0.5
MOST_STRENGTH = 1e9
EDGE = 1e-6


@dataclass
class Prior:
    """The global mean and how many documents a level's prior weighs."""

    mean: float
    host_strength: float
    path_strength: float


def with_evidence(docs: DataFrame, model: TextModel, name: str = "evidence") -> DataFrame:
    """``docs`` and the classifier's calibrated log-odds of each whole text (null: empty)."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    at = docs.columns.index("text")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.logits(batch.column(at)))], names=[*batch.schema.names, name])

    return docs.mapInArrow(add, ", ".join([*fields, f"`{name}` double"]))


def probability(logit: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def logit(p: Column) -> Column:
    inside = F.greatest(F.lit(EDGE), F.least(F.lit(1 - EDGE), p))
    return F.log(inside / (F.lit(1.0) - inside))


def site_sums(scored: DataFrame, host: str, path: str, evidence: str = "evidence") -> DataFrame:
    """Documents and summed probabilities of each path and of its host, aggregated before the shuffle."""
    p = probability(F.col(evidence))
    paths = saved(scored.groupBy(F.col(host).alias("_host"), F.col(path).alias("_path")).agg(F.count("*").alias("_n"), F.sum(p).alias("_p"), F.sum(p * p).alias("_pp")), "sites")
    hosts = paths.groupBy(F.col("_host").alias("_of")).agg(F.sum("_n").alias("_host_n"), F.sum("_p").alias("_host_p"))
    return saved(paths.join(hosts, F.col("_host").eqNullSafe(F.col("_of"))).drop("_of"), "sites")


def fit_prior(sites: DataFrame) -> Prior:
    """Variance components of the one-way analysis, hosts within the corpus and paths within hosts.

    A level's strength is the variance within over the variance between: where
    units differ no more than chance would have it, they shrink all the way.
    """
    hosts = sites.groupBy("_host").agg(F.first("_host_n").alias("n"), F.first("_host_p").alias("p"))
    h = hosts.agg(F.count("*").alias("units"), F.sum("n").alias("n"), F.sum("p").alias("p"), F.sum(F.col("p") * F.col("p") / F.col("n")).alias("between"), F.sum(F.col("n") * F.col("n")).alias("nn")).first()
    s = sites.agg(F.count("*").alias("units"), F.sum("_pp").alias("pp"), F.sum(F.col("_p") * F.col("_p") / F.col("_n")).alias("between"), F.sum(F.col("_n") * F.col("_n") / F.col("_host_n")).alias("nn")).first()
    if not h["n"]:
        return Prior(0.5, MOST_STRENGTH, MOST_STRENGTH)
    n, mean = float(h["n"]), h["p"] / h["n"]
    within_path = max(0.0, s["pp"] - s["between"]) / max(1.0, n - s["units"])
    within_host = max(0.0, s["pp"] - h["between"]) / max(1.0, n - h["units"])
    host_var = (h["between"] - n * mean * mean - (h["units"] - 1) * within_host) / max(1.0, n - h["nn"] / n)
    path_var = (s["between"] - h["between"] - (s["units"] - h["units"]) * within_path) / max(1.0, n - s["nn"])
    return Prior(mean, _strength(within_host, host_var), _strength(within_path, path_var))


def _strength(within: float, between: float) -> float:
    if between <= 0 or not math.isfinite(between):
        return MOST_STRENGTH
    return min(MOST_STRENGTH, max(1.0, within / between))


def combine(scored: DataFrame, sites: DataFrame, prior: Prior, host: str, path: str, evidence: str = "evidence", least: float = LEAST_PROBABILITY) -> DataFrame:
    """Each document's posterior: its evidence on the odds of its path.

    A path's prior is its host's posterior, a host's the corpus's mean; a
    document's own evidence is left out of both sums.  Adds
    ``document_probability, host_posterior, path_posterior, quality_posterior``
    and ``kept``.  Null hosts and paths are sites like any other.
    """
    near = scored[host].eqNullSafe(sites["_host"]) & scored[path].eqNullSafe(sites["_path"])
    own = probability(F.col(evidence))
    joined = scored.join(sites, near, "left")
    host_mean = (F.lit(prior.host_strength * prior.mean) + F.col("_host_p") - own) / (F.lit(prior.host_strength) + F.col("_host_n") - 1)
    path_mean = (F.lit(prior.path_strength) * F.col("host_posterior") + F.col("_p") - own) / (F.lit(prior.path_strength) + F.col("_n") - 1)
    joined = joined.withColumn("document_probability", own).withColumn("host_posterior", host_mean).withColumn("path_posterior", path_mean)
    joined = joined.withColumn("quality_posterior", probability(F.col(evidence) + logit(F.col("path_posterior")) - logit(F.lit(prior.mean))))
    return joined.withColumn("kept", F.col("quality_posterior") >= F.lit(least)).drop("_host", "_path", "_n", "_p", "_pp", "_host_n", "_host_p")


def site_quality(docs: DataFrame, model: TextModel, host: str = "source", path: str = "lang", key: str = "doc_id", least: float = LEAST_PROBABILITY) -> DataFrame:
    """``key, host, path`` and the posteriors of every document; texts are read once and not shuffled.

    ``host`` and ``path`` name columns (:func:`url_sites` makes them from
    URLs).  Null texts are scored as empty and whole texts of any length;
    repeated rows are documents each; an empty table gives no rows.
    """
    columns = docs.select(F.col(key), F.col(host).alias("host"), F.col(path).alias("path"), "text")
    scored = saved(with_evidence(columns, model).drop("text"), "evidence")
    sites = site_sums(scored, "host", "path")
    return combine(scored, sites, fit_prior(sites), "host", "path", least=least)


def kept_documents(docs: DataFrame, model: TextModel, host: str = "source", path: str = "lang", least: float = LEAST_PROBABILITY) -> DataFrame:
    """The rows of ``docs`` whose posterior is at least ``least``, with their columns.

    A row travels as one struct, so its names can't clash with the sums'.
    Texts are scored twice, once for the sites and once for the verdicts, so
    that they needn't be shuffled or written.  A null text is scored as empty;
    repeated rows are documents each; an empty table gives no rows.
    """
    evidence = free_name(docs, "evidence")
    scored = with_evidence(docs.select(*docs.columns), model, evidence)
    scored = scored.select(F.struct(*docs.columns).alias("doc"), F.col(host).alias("host"), F.col(path).alias("path"), F.col(evidence).alias("evidence"))
    sites = site_sums(with_evidence(docs.select("text", F.col(host).alias("host"), F.col(path).alias("path")), model).drop("text"), "host", "path")
    return combine(scored, sites, fit_prior(sites), "host", "path", least=least).where("kept").select("doc.*")


def url_sites(pages: DataFrame, url: str = "url") -> tuple[Column, Column]:
    """Host and path of ``url`` as the levels of a site: lower-case host, and the path's first folder.

    A URL without a host gives null for both; the path of a page at the top
    is "/".
    """
    host = F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    folder = F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^/?#]+/)", 1)
    host = F.when(host != "", host)
    return host, F.when(host.isNotNull(), F.when(folder != "", folder).otherwise("/"))
