"""Language of documents and pages by fused evidence (operator 8).

Log-probabilities of four kinds of evidence add up for each language (and for
`und`, no known language):

* text: mean log-likelihood of hashed letter triplets of the whole text under each
  language's model, times at most FULL_WEIGHT triplets, since neighbouring triplets
  are not independent; `und` is a text REJECT_MARGIN less likely than usual, and at
  most as likely as triplets drawn at random;
* declared: the language named by the markup (a page's html element, a document's
  lang), right with probability RELIABILITY;
* address suffix: a country suffix names its language with SUFFIX_RELIABILITY, other
  suffixes say nothing;
* host prior: the languages of the other texts of the same host, smoothed towards
  those of its domain, of its suffix and of the corpus, PRIOR_ROWS each.

Host counts are grouped aggregates of the text evidence over all rows, hosts first,
then domains and suffixes from the hosts' sums; a row's own part is taken out.

The languages are those of all labelled documents with MIN_DOCUMENTS rows or more. The
model of each is counted from about SAMPLE_ROWS of its different documents (smallest
hashes of id and text; all of them where there are fewer), so the bound holds for each
language, however large the table and whatever share of it the language has. Counts
and priors cover every row.

Cases: null and empty texts and texts without letters have no text evidence and are
rejected; unknown or null declared languages, hosts and urls say nothing; repeated
rows each count and stay; equal probabilities go to the language first in the
alphabet; an empty table gives no rows; without labelled rows every text is `und`;
extra columns are kept in `accepted_documents` and dropped elsewhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from crossmer.llm.common import content_key, pieces, table
from crossmer.llm.url_rules import host_of
from crossmer.llm.words import batches as byte_batches
from crossmer.operators.storage import materialize

SAMPLE_ROWS = 6_000          # of each language
BUCKETS = 1 << 16
MIN_DOCUMENTS = 5            # labelled documents of a language, at least
FULL_WEIGHT = 200
REJECT_MARGIN = 4.0          # nats per triplet
UNKNOWN_PRIOR = 1e-3         # share of texts in no known language, before any evidence
RELIABILITY = 0.9
SUFFIX_RELIABILITY = 0.7
PRIOR_ROWS = 20.0
UNKNOWN = "und"
LARGEST_ODDS = 1e-12         # no evidence makes a language impossible

# Country suffixes and their main language.
SUFFIX_LANGUAGES = {
    "uk": "en", "us": "en", "au": "en", "ie": "en", "nz": "en", "de": "de", "at": "de", "fr": "fr", "es": "es",
    "mx": "es", "ar": "es", "co": "es", "cl": "es", "pe": "es", "it": "it", "nl": "nl", "pt": "pt", "br": "pt",
    "pl": "pl", "se": "sv", "dk": "da", "no": "no", "fi": "fi", "cz": "cs", "ru": "ru", "jp": "ja", "cn": "zh", "kr": "ko",
}

_LETTER = np.full(256, 32, dtype=np.uint8)       # everything but letters is a space
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)
_TAGS = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.DOTALL | re.IGNORECASE)


def page_text(html: str | None) -> str:
    return _TAGS.sub(" ", html) if html else ""


def triplets(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed letter triplets of a batch of texts and, for each text, how many come before it."""
    data = _LETTER[np.frombuffer(b" " + b" ".join(raw) + b"  ", dtype=np.uint8)].astype(np.uint32)
    codes = data[:-2] << np.uint32(16) | data[1:-1] << np.uint32(8) | data[2:]
    owner = np.repeat(np.arange(len(raw)), [len(r) + 1 for r in raw])      # by the middle byte
    inside = data[1:-1] != 32                     # a triplet counts where its middle is a letter
    hashed = (codes[inside] * np.uint32(2654435761)) >> np.uint32(16)
    return hashed, np.searchsorted(owner[inside], np.arange(len(raw) + 1))


# --- the text models -----------------------------------------------------------------------

class TextModels:
    """Smoothed log-probabilities of triplets per language, and how likely usual texts are."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smooth = counts + 0.5 * (counts.sum(axis=1, keepdims=True) + 1) / BUCKETS / 10
        self.logs = np.log(smooth / smooth.sum(axis=1, keepdims=True)).T.astype(np.float32).copy()
        shares = counts / np.maximum(1, counts.sum(axis=1, keepdims=True))
        usual = (shares * self.logs.T).sum(axis=1) if languages else np.zeros(0)
        self.unknown = min(float(usual.min() - REJECT_MARGIN), -float(np.log(BUCKETS))) if languages else 0.0

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Mean log-likelihood under each language (last column: unknown), and the number of triplets."""
        means = np.zeros((len(texts), len(self.languages) + 1))
        sizes = np.zeros(len(texts), dtype=np.int64)
        for start, raw in byte_batches(texts, 1 << 20):
            hashed, bounds = triplets(raw)
            n = np.diff(bounds)
            for k in range(len(self.languages)):
                sums = np.concatenate([[0.0], np.cumsum(self.logs[hashed, k], dtype=np.float64)])
                means[start:start + len(raw), k] = (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(1, n)
            sizes[start:start + len(raw)] = n
        means[:, -1] = self.unknown
        return means, sizes


def fit_text_models(documents: DataFrame, limit: int = SAMPLE_ROWS) -> TextModels:
    """Triplet counts of about `limit` documents (doc_id, text, lang) of every language."""
    spark = documents.sparkSession
    labelled = documents.filter("lang IS NOT NULL").select(
        "text", "lang", F.xxhash64(F.col("doc_id").cast("long"), "text").alias("place"))
    known = {
        r["lang"]: (r["rows"], r["different"]) for r in
        labelled.groupBy("lang", "place").agg(F.count("*").alias("n"))
        .groupBy("lang").agg(F.sum("n").alias("rows"), F.count("*").alias("different"))
        .filter(F.col("rows") >= MIN_DOCUMENTS).collect()      # one row per language with a model
    }
    if not known:
        return TextModels([], np.zeros((0, BUCKETS)))
    # places are spread evenly, so a share of their range holds that share of the documents
    below = [(language, -(1 << 63) + min((1 << 64) - 1, (limit << 64) // different))
             for language, (_, different) in known.items()]
    sample = (
        labelled.join(F.broadcast(spark.createDataFrame(below, "lang string, below long")), "lang")
        .filter("place <= below").dropDuplicates(["lang", "place"]).select("text", "lang")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in pieces(batches, "text", 2 << 20):
            texts, languages = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for language in set(languages):
                own = [t for t, l in zip(texts, languages, strict=True) if l == language]
                total = counts.setdefault(language, np.zeros(BUCKETS, dtype=np.int64))
                for _, raw in byte_batches(own):
                    total += np.bincount(triplets(raw)[0], minlength=BUCKETS)
        for language, total in counts.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([language] * len(used)), pa.array(used), pa.array(total[used])], ["lang", "bucket", "n"])

    found = (
        sample.mapInArrow(run, "lang string, bucket long, n long")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
        .toPandas()          # at most BUCKETS rows per language
    )
    languages = sorted(known)
    counts = np.zeros((len(languages), BUCKETS))
    for k, language in enumerate(languages):
        own = found[found.lang == language]
        counts[k, own.bucket.to_numpy()] = own.n.to_numpy()
    return TextModels(languages, counts)


# --- evidence ----------------------------------------------------------------------------------

def _softmax(logs: np.ndarray) -> np.ndarray:
    weights = np.exp(logs - logs.max(axis=1, keepdims=True))
    return weights / weights.sum(axis=1, keepdims=True)


def text_evidence(rows: DataFrame, models: TextModels, html: bool = False) -> DataFrame:
    """id, declared, host and suffix with `size` (triplets) and `logs` (text log-likelihood per language)."""
    shared = rows.sparkSession.sparkContext.broadcast(models)
    names = ["id", "declared", "host", "suffix"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in pieces(batches, "text", 2 << 20):
            texts = batch.column(4).to_pylist()
            means, sizes = own.score([page_text(t) for t in texts] if html else texts)
            logs = means * np.minimum(sizes, FULL_WEIGHT)[:, None]
            width = logs.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, logs.size + 1, width, dtype=np.int32)), pa.array(logs.ravel()))
            text_only = pa.ListArray.from_arrays(
                pa.array(np.arange(0, logs.size + 1, width, dtype=np.int32)),
                pa.array((_softmax(logs) * (sizes > 0)[:, None]).ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sizes), lists, text_only],
                                             [*names, "size", "logs", "parts"])

    schema = (f"id {rows.schema['id'].dataType.simpleString()}, declared string, host string, suffix string, size long, "
              "logs array<double>, parts array<double>")
    no_null = [F.coalesce(n, F.lit("")).alias(n) for n in ("host", "suffix")]
    return rows.select("id", "declared", *no_null, "text").mapInArrow(run, schema)


def host_sums(evidence: DataFrame, width: int) -> DataFrame:
    """host, and as arrays the summed text evidence of the host, its domain, its suffix and all rows."""
    def total(name: str):
        return [F.sum(F.get(name, F.lit(k))).alias(f"s{k}") for k in range(width)]

    def packed(name: str):
        return F.array(*[F.coalesce(F.col(f"s{k}"), F.lit(0.0)) for k in range(width)]).alias(name)

    hosts = evidence.groupBy("host", "suffix").agg(*total("parts")).select(
        "host", "suffix", packed("of_host"), domain_of(F.col("host")).alias("domain"))
    domains = hosts.groupBy("domain").agg(*total("of_host")).select("domain", packed("of_domain"))
    suffixes = hosts.groupBy("suffix").agg(*total("of_host")).select("suffix", packed("of_suffix"))
    everything = suffixes.agg(*total("of_suffix")).select(packed("of_all"))
    return (
        hosts.join(domains, "domain").join(suffixes, "suffix").crossJoin(F.broadcast(everything))       # one row
        .select(F.col("host").alias("prior_host"), F.col("suffix").alias("prior_suffix"),
                "of_host", "of_domain", "of_suffix", "of_all")
    )


def domain_of(host: Column) -> Column:
    """The last two labels of a host."""
    labels = F.split(host, r"\.")
    return F.when(F.size(labels) > 2, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(host)


RESULT = "language string, probability double, text_language string, size long, accepted boolean"


def fuse(evidence: DataFrame, languages: list[str]) -> DataFrame:
    """id, language, probability, text_language, size, accepted."""
    evidence = materialize(evidence)
    names = [*languages, UNKNOWN]
    width = len(names)
    sums = host_sums(evidence, width)
    joined = evidence.join(sums, (F.col("host") == F.col("prior_host")) & (F.col("suffix") == F.col("prior_suffix")))
    index = {l: k for k, l in enumerate(languages)}

    def named(values: list, reliability: float) -> np.ndarray:
        """Log-likelihood of a named language: right with `reliability`, otherwise any other."""
        logs = np.zeros((len(values), width))
        for i, value in enumerate(values):
            k = index.get((value or "").strip().lower().replace("_", "-").split("-")[0])
            if k is not None:
                logs[i] = np.log((1 - reliability) / max(1, width - 1))
                logs[i, k] = np.log(reliability)
        return logs

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}

            def matrix(name: str, column=column) -> np.ndarray:
                return column[name].flatten().to_numpy(zero_copy_only=False).reshape(-1, width)

            own, sizes = matrix("parts"), column["size"].to_numpy()
            prior = np.full_like(own, (1 - UNKNOWN_PRIOR) / max(1, width - 1))
            prior[:, -1] = UNKNOWN_PRIOR
            for level in ("of_all", "of_suffix", "of_domain", "of_host"):
                rest = np.maximum(0.0, matrix(level) - own)
                prior = (rest + PRIOR_ROWS * prior) / (rest.sum(axis=1, keepdims=True) + PRIOR_ROWS)
            texts = matrix("logs")
            suffixes = [SUFFIX_LANGUAGES.get(s) for s in column["suffix"].to_pylist()]
            logs = (texts + np.log(np.maximum(prior, LARGEST_ODDS)) + named(column["declared"].to_pylist(), RELIABILITY)
                    + named(suffixes, SUFFIX_RELIABILITY))
            posterior = _softmax(logs)
            best, alone = posterior.argmax(axis=1), texts.argmax(axis=1)
            accepted = (best < width - 1) & (sizes > 0)
            yield pa.RecordBatch.from_arrays(
                [column["id"], pa.array([names[k] for k in best]), pa.array(posterior[np.arange(len(best)), best]),
                 pa.array([names[k] if n else UNKNOWN for k, n in zip(alone, sizes, strict=True)]), pa.array(sizes),
                 pa.array(accepted)],
                ["id", "language", "probability", "text_language", "size", "accepted"])

    columns = ["id", "declared", "suffix", "size", "logs", "parts", "of_host", "of_domain", "of_suffix", "of_all"]
    return joined.select(*columns).mapInArrow(
        run, f"id {evidence.schema['id'].dataType.simpleString()}, {RESULT}")


def identify_documents(documents: DataFrame, models: TextModels, key: Column | None = None) -> DataFrame:
    """Documents (doc_id, text, lang, source): lang is the declared language, source the host; id is `key` or doc_id."""
    rows = documents.select((F.col("doc_id").cast("long") if key is None else key).alias("id"), F.col("lang").cast("string").alias("declared"),
                            F.col("source").cast("string").alias("host"), F.lit(None).cast("string").alias("suffix"), "text")
    return fuse(text_evidence(rows, models), models.languages)


def identify_pages(pages: DataFrame, models: TextModels) -> DataFrame:
    """Pages (page_id, url, html): language of the html element, host and suffix of the address."""
    host = host_of(F.col("url"))
    suffix = F.when(host.contains("."), F.element_at(F.split(host, r"\."), -1))
    declared = F.regexp_extract("html", r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z-]+)""", 1)
    rows = pages.select(F.col("page_id").cast("long").alias("id"), declared.alias("declared"), host.alias("host"),
                        suffix.alias("suffix"), F.col("html").alias("text"))
    return fuse(text_evidence(rows, models, html=True), models.languages)


def accepted_documents(documents: DataFrame, models: TextModels) -> DataFrame:
    """The documents with a known language, with all their columns.

    A row is named by all that decides about it, so rows that share a doc_id or have none are told apart.
    """
    key = content_key("doc_id", "text", "lang", "source")
    found = identify_documents(documents, models, key).filter("accepted").select(F.col("id").alias("accepted_key")).distinct()
    return documents.join(found, key == F.col("accepted_key"), "left_semi")


def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return identify_documents(documents, fit_text_models(documents)).withColumnRenamed("id", "doc_id")


def op8_language_id_pages(spark: SparkSession, folder: str) -> DataFrame:
    models = fit_text_models(table(spark, folder, "documents"))
    return identify_pages(table(spark, folder, "pages"), models).withColumnRenamed("id", "page_id")
