"""Registered queries: one per operator, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from crossmer import constants as C
from crossmer.functions import physchem as P, sequence as Q, statistics as S
from crossmer.operators import loading, ordering, scoring, seeds, tables, tags
from crossmer.operators.indexed import KmerIndex
from crossmer.operators.storage import materialize
from crossmer.operators.nodes import NodeSet, attach, both_directions, build_nodes
from crossmer.plans import lookup, quality, screen
from crossmer.sources.tables import (
    document_lines, item_antigens, letter_antigens, message_antigens, word_antigens,
)

TAG = "THEANDTHE"   # a frequent opening of the English lines
UPSERT_LANGUAGE = "en"

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def query(function: Query) -> Query:
    _REGISTRY[function.__name__] = function
    return function


def all_queries() -> dict[str, Query]:
    return dict(_REGISTRY)


# --- shared inputs ---------------------------------------------------------------

def _neighbours(antigens: DataFrame) -> DataFrame:
    """Every antigen with the next one of the same document."""
    following = W.partitionBy("doc_id").orderBy("pos")
    return (
        antigens.select("doc_id", "pos", "id", "sequence")
        .withColumn("next_id", F.lead("id").over(following))
        .withColumn("next_sequence", F.lead("sequence").over(following))
        .filter(F.col("next_id").isNotNull())
        .select("id", "next_id", "sequence", "next_sequence")
    )


def _residues(frame: DataFrame) -> int:
    return int(frame.agg(F.coalesce(F.sum(F.length("sequence")), F.lit(0))).first()[0])


def _word_nodes(spark, folder) -> NodeSet:
    return build_nodes(word_antigens(spark, folder))


def _message_nodes(spark, folder) -> NodeSet:
    return build_nodes(message_antigens(spark, folder))


def _item_nodes(spark, folder) -> NodeSet:
    return build_nodes(item_antigens(spark, folder))


def _named(directed: DataFrame, nodes: NodeSet, *columns) -> DataFrame:
    """Pairs under the first id of each sequence, with its number of copies (see `identical_copies`)."""
    return attach(directed, nodes.frame, ["id", "copies"]).select(
        F.col("q_id").alias("query_id"), F.col("t_id").alias("target_id"),
        F.col("q_copies").alias("query_copies"), F.col("t_copies").alias("target_copies"), *columns)


ENDS = ("id", "copies")


def _under_ids(directed: DataFrame, *columns) -> DataFrame:
    """The columns of _named() for pairs that carry ENDS."""
    return directed.select(
        F.col("q_id").alias("query_id"), F.col("t_id").alias("target_id"),
        F.col("q_copies").alias("query_copies"), F.col("t_copies").alias("target_copies"), *columns)


def _rank(*order: Column) -> Column:
    """Place of a candidate among those of its query; ties in input order."""
    return F.row_number().over(W.partitionBy("q_node").orderBy(*order, "t_node")).alias("rank")


def _joined(array) -> Column:
    return F.array_join(array, ",")


def _log_evalue(value) -> Column:
    return S.round_to(F.log10(value), 6)


def _pairs_out(hits: DataFrame) -> DataFrame:
    """Stored pair columns with the E-value as a rounded logarithm."""
    return hits.select(
        "q_copies", "t_copies", *[c for c in screen.PAIR_COLUMNS if c != "evalue"],
        _log_evalue(F.col("evalue")).alias("log_evalue"))


# --- loading -----------------------------------------------------------------------

@query
def clean_sequence(spark, folder):
    return document_lines(spark, folder).select(
        "id", Q.clean_sequence(F.col("line")).alias("sequence"))


@query
def valid_sequences(spark, folder):
    return letter_antigens(spark, folder).select("id", F.length("sequence").alias("length"))


def _source_records(spark, folder) -> DataFrame:
    """Lines under the name of their source, so that most ids repeat."""
    return loading.clean_records(document_lines(spark, folder).select(
        F.col("ordinal").alias("row_num"), F.col("source").alias("id"), F.col("line").alias("raw")))


@query
def clean_load(spark, folder):
    valid = _source_records(spark, folder).filter("valid").drop("valid")
    return loading.unique_ids(valid).select("row_num", "id", "sequence", "renamed")


@query
def fasta_load_ids(spark, folder):
    valid = _source_records(spark, folder).filter("valid").drop("valid")
    return loading.unique_ids(valid, suffix="dup").select("row_num", "id")


@query
def load_stats(spark, folder):
    return loading.load_counters(_source_records(spark, folder))


# --- tags ----------------------------------------------------------------------------

@query
def strip_tag_exact(spark, folder):
    found = letter_antigens(spark, folder).withColumn(
        "_s", tags.strip_tag_exact(F.col("sequence"), TAG))
    return found.select("id", "_s.stripped", "_s.tag_found")


@query
def strip_tag_sw(spark, folder):
    found = letter_antigens(spark, folder).withColumn(
        "_s", tags.strip_tag_sw(F.col("sequence"), TAG))
    return found.select("id", "_s.stripped", "_s.tag_found", "_s.score")


@query
def strip_tag(spark, folder):
    return tags.strip_tags(letter_antigens(spark, folder), "sequence", TAG).select(
        "id", "stripped", "tag_found", "method_used", "score")


@query
def tag_stats(spark, folder):
    return tags.strip_tags(letter_antigens(spark, folder), "sequence", TAG).groupBy(
        "method_used").agg(F.count("*").alias("antigens"), F.count_if("tag_found").alias("found"))


# --- sequence functions ------------------------------------------------------------

@query
def blosum_lookup(spark, folder):
    score = Q.blosum_lookup()
    pairs = letter_antigens(spark, folder).select(
        F.explode(Q.kmers(F.col("sequence"), 2)).alias("pair"))
    return pairs.groupBy("pair").agg(F.count("*").alias("n")).withColumn(
        "score", score(F.substring("pair", 1, 1), F.substring("pair", 2, 1)))


@query
def encode_sequence(spark, folder):
    return letter_antigens(spark, folder).select(
        "id", _joined(Q.encode_residues(F.col("sequence"))).alias("codes"))


@query
def reduce_sequence(spark, folder):
    return letter_antigens(spark, folder).select(
        "id", Q.reduce_sequence(F.col("sequence")).alias("reduced"))


@query
def kmer_sets(spark, folder):
    found = Q.kmer_set(F.col("sequence"))
    return word_antigens(spark, folder).select(
        "id", F.size(found).alias("n_kmers"), _joined(F.array_sort(found)).alias("kmers"))


@query
def kmer_positions(spark, folder):
    return word_antigens(spark, folder).select(
        "id", F.posexplode(Q.kmers(F.col("sequence"), C.CHAIN_K)).alias("pos", "kmer"))


@query
def reduced_kmers(spark, folder):
    reduced = Q.reduce_sequence(F.col("sequence"))
    return word_antigens(spark, folder).select(
        "id", F.posexplode(Q.kmers(reduced, C.REDUCED_K)).alias("pos", "kmer")
    ).filter(~F.contains("kmer", F.lit("?")))


@query
def jaccard_pair(spark, folder):
    return _neighbours(letter_antigens(spark, folder)).select(
        "id", "next_id", S.round_to(Q.kmer_overlap("sequence", "next_sequence"), 6).alias("jaccard"))


# --- statistics --------------------------------------------------------------------

@query
def ka_params(spark, folder):
    """Effective search space of every antigen length under every gap setting."""
    antigens = letter_antigens(spark, folder)
    size = _residues(antigens)
    settings = F.array(*[
        F.struct(F.lit(e).alias("existence"), F.lit(x).alias("extension"), F.lit(l).alias("lam"),
                 F.lit(k).alias("k"), F.lit(h).alias("h"))
        for (e, x), (l, k, h) in C.KARLIN_ALTSCHUL.items()])
    lengths = antigens.groupBy(F.length("sequence").alias("length")).agg(
        F.count("*").alias("antigens"))
    # H differs per setting, so the expression is built for each and picked by position
    spaces = F.array(*[
        S.effective_length(F.col("length"), k, h, size) for _, k, h in C.KARLIN_ALTSCHUL.values()])
    return lengths.select("length", "antigens", F.posexplode(F.arrays_zip(
        settings.alias("s"), spaces.alias("m"))).alias("at", "z")).select(
        "length", "antigens", "z.s.existence", "z.s.extension", "z.s.lam", "z.s.k", "z.s.h",
        F.col("z.m").alias("m_eff"))


@query
def effective_length(spark, folder):
    antigens = letter_antigens(spark, folder)
    size = _residues(antigens)
    _, k, h = S.karlin_altschul()
    return antigens.groupBy(F.length("sequence").alias("length")).agg(
        F.count("*").alias("antigens")).withColumns({
            "m_eff": S.effective_length(F.col("length"), k, h, size),
            "d_eff": S.effective_length(F.lit(size), k, h, F.col("length"))})


def _ungapped_neighbours(spark, folder) -> tuple[DataFrame, int]:
    antigens = letter_antigens(spark, folder)
    size = _residues(antigens)
    return _neighbours(antigens).select(
        "id", "next_id", F.length("sequence").alias("length"),
        Q.ungapped_score(F.col("sequence"), F.col("next_sequence")).alias("raw_score")), size


@query
def bit_score(spark, folder):
    pairs, _ = _ungapped_neighbours(spark, folder)
    lam, k, _ = S.karlin_altschul()
    return pairs.select("id", "next_id", "raw_score", S.round_to(
        S.bit_score(F.col("raw_score"), lam, k), 1).alias("bit_score"))


def _evalues(spark, folder) -> DataFrame:
    pairs, size = _ungapped_neighbours(spark, folder)
    ka = S.karlin_altschul()
    return pairs.withColumns({
        "pairwise": S.evalue(F.col("raw_score"), F.col("length"), size, *ka),
        "batch": S.evalue(F.col("raw_score"), F.col("length"), size, *ka, batch=True)})


@query
def evalue(spark, folder):
    return _evalues(spark, folder).select(
        "id", "next_id", _log_evalue(F.col("pairwise")).alias("log_pairwise"),
        _log_evalue(F.col("batch")).alias("log_batch"))


@query
def evalue_significance(spark, folder):
    return _evalues(spark, folder).groupBy(
        S.significance(F.col("pairwise")).alias("significance")).agg(F.count("*").alias("pairs"))


@query
def format_evalue(spark, folder):
    return _evalues(spark, folder).select(
        "id", "next_id", S.format_evalue_text(F.col("pairwise")).alias("text"))


# --- physicochemistry ----------------------------------------------------------------

def _profile(function) -> Query:
    return lambda spark, folder: letter_antigens(spark, folder).select(
        "id", _joined(function(F.col("sequence"))).alias("profile"))


_REGISTRY["hydro_profile"] = _profile(P.hydrophobicity_profile)
_REGISTRY["charge_profile"] = _profile(P.charge_profile)
_REGISTRY["binary_profile"] = _profile(P.binary_profile)


@query
def net_charge(spark, folder):
    return letter_antigens(spark, folder).select(
        "id", S.round_to(P.net_charge(F.col("sequence"), 7.0), 4).alias("charge"))


@query
def isoelectric_point(spark, folder):
    return letter_antigens(spark, folder).select(
        "id", S.round_to(P.isoelectric_point(F.col("sequence")), 3).alias("pi"))


@query
def profile_pearson(spark, folder):
    return _neighbours(letter_antigens(spark, folder)).withColumn(
        "_r", P.residue_correlations("sequence", "next_sequence")).select(
        "id", "next_id", S.round_to(F.col("_r.hydrophobicity"), 6).alias("hydrophobicity"),
        S.round_to(F.col("_r.charge"), 6).alias("charge"))


@query
def max_xcorr(spark, folder):
    metrics = P.profile_metrics(F.col("sequence"), F.col("next_sequence"))
    return _neighbours(word_antigens(spark, folder)).withColumn("_m", metrics).select(
        "id", "next_id", S.round_to(F.col("_m.hydrophobicity_cross_corr"), 6).alias("cross_corr"))


def _annotated_neighbours(spark, folder, hit=None, extra=None) -> DataFrame:
    pairs = _neighbours(word_antigens(spark, folder)).withColumns({
        "pi": P.isoelectric_point(F.col("sequence")),
        "next_pi": P.isoelectric_point(F.col("next_sequence"))})
    if extra:
        pairs = extra(pairs)
    return P.annotate(pairs, "sequence", "next_sequence", "pi", "next_pi", F.lit(True) if hit is None else hit)


@query
def physchem_similarity(spark, folder):
    return _annotated_neighbours(spark, folder).select(
        "id", "next_id", *screen.PAIR_COLUMNS[13:20])


@query
def detection_source(spark, folder):
    size = _residues(word_antigens(spark, folder))
    aligned = lambda pairs: scoring.align_pair(pairs, "sequence", "next_sequence", size)
    return _annotated_neighbours(
        spark, folder, F.col("evalue") <= C.MAX_EVALUE, aligned
    ).groupBy("detection_source").agg(F.count("*").alias("pairs"))


# --- alignment -------------------------------------------------------------------------

@query
def sw_score(spark, folder):
    return _neighbours(word_antigens(spark, folder)).withColumn(
        "_s", scoring.sw_align(F.col("sequence"), F.col("next_sequence"))
    ).select("id", "next_id", "_s.raw_score", "_s.target_end")


@query
def sw_batch(spark, folder):
    return _neighbours(word_antigens(spark, folder)).withColumn(
        "_s", scoring.sw_batch(F.col("sequence"), F.col("next_sequence"))
    ).select("id", "next_id", "_s.*")


@query
def align_pair(spark, folder):
    antigens = word_antigens(spark, folder)
    return scoring.align_pair(
        _neighbours(antigens), "sequence", "next_sequence", _residues(antigens)
    ).select("id", "next_id", "raw_score", S.round_to(F.col("bit_score"), 1).alias("bit_score"),
             _log_evalue(F.col("evalue")).alias("log_evalue"), "query_length", "target_length",
             "aligned_region_len")


@query
def contiguous_match(spark, folder):
    nodes = _word_nodes(spark, folder)
    return _under_ids(seeds.contiguous_matches(nodes, carried=ENDS, grouped=False), "run", "run_query_end", "run_target_end")


# --- candidates --------------------------------------------------------------------------

@query
def kmer_jaccard_join(spark, folder):
    nodes = _word_nodes(spark, folder)
    return _under_ids(both_directions(seeds.jaccard_pairs(nodes, carried=ENDS), "jaccard", ends=ENDS),
                      S.round_to(F.col("jaccard"), 6).alias("jaccard"), _rank(F.desc("jaccard")))


@query
def kmer_chain_join(spark, folder):
    nodes = _word_nodes(spark, folder)
    return _under_ids(both_directions(seeds.chain_pairs(nodes, carried=ENDS), ends=ENDS))


@query
def two_pass_candidates(spark, folder):
    nodes = _word_nodes(spark, folder)
    return _under_ids(both_directions(seeds.two_pass_pairs(nodes, carried=ENDS), "jaccard", ends=ENDS),
                      S.round_to(F.col("jaccard"), 6).alias("jaccard"), _rank(F.desc("jaccard")))


def _searched(spark, folder, search) -> DataFrame:
    """Pairs of all benchmark items with the indexed document lines, which are added in two batches."""
    nodes = _word_nodes(spark, folder).frame
    index = KmerIndex(spark).add(nodes.filter("copies = 1")).add(nodes.filter("copies > 1"))
    items = word_items(spark, folder).select(F.col("ordinal").alias("node"), "sequence")
    return attach(search(index, items), nodes, ["id", "copies"], sides=("t",)).withColumnsRenamed(
        {"q_node": "item_id", "t_id": "target_id", "t_copies": "target_copies"})


def _ranked_items(found: DataFrame) -> DataFrame:
    order = W.partitionBy("item_id").orderBy(F.desc("jaccard"), "t_node")
    return found.select("item_id", "target_id", "target_copies", S.round_to(F.col("jaccard"), 6).alias("jaccard"),
                        F.row_number().over(order).alias("rank"))


@query
def index_jaccard(spark, folder):
    return _ranked_items(_searched(spark, folder, lambda index, items: index.jaccard(items)))


@query
def index_chain(spark, folder):
    return _searched(spark, folder, lambda index, items: index.common_runs(items)).select(
        "item_id", "target_id", "target_copies")


@query
def index_candidates(spark, folder):
    return _ranked_items(_searched(spark, folder, lambda index, items: index.two_pass(items)))


@query
def index_diagonals(spark, folder):
    """Best diagonal chain of every benchmark item with every document line that shares a reduced seed."""
    items = build_nodes(word_items(spark, folder).withColumn("id", F.col("ordinal")))
    found = seeds.diagonal_details(items, targets=_word_nodes(spark, folder), grouped=False)
    return found.select(
        F.col("query_id").alias("item_id"), "target_id", "chain_length", "diagonal", "chain_start_qpos", "region_len",
        S.round_to(F.col("blosum62_mean"), 4).alias("blosum62_mean"), "passed_chain", "rescued",
        _rank(F.desc("chain_length"), F.desc_nulls_last("blosum62_mean")))


@query
def live_items(spark, folder):
    """All benchmark items against the indexed document lines: the best antigens of each."""
    antigens = word_antigens(spark, folder)
    nodes = build_nodes(antigens)
    items = word_items(spark, folder).select(F.col("ordinal").alias("node"), "sequence")
    found = lookup.live_queries(items, KmerIndex(spark).add(nodes.frame), nodes, antigens, max_evalue=C.EXPORT_MAX_EVALUE)
    return found.select(
        F.col("q_node").alias("item_id"), "rank", "target_id", "raw_score", S.round_to(F.col("bit_score"), 1).alias("bit_score"),
        _log_evalue(F.col("evalue")).alias("log_evalue"), "significance", "aligned_region_len", "query_length", "target_length")


@query
def ra_candidates(spark, folder):
    nodes = _message_nodes(spark, folder)
    return _under_ids(seeds.diagonal_pairs(nodes, carried=ENDS))


@query
def ra_rescue(spark, folder):
    """Directed pairs that pass without a chain."""
    nodes = _message_nodes(spark, folder)
    rescued = seeds.reduced_pairs(nodes, carried=ENDS, grouped=False).filter(~F.col("chained"))
    return _under_ids(seeds.passing_ways(rescued, ENDS))


@query
def ra_details(spark, folder):
    nodes = _message_nodes(spark, folder)
    found = seeds.diagonal_details(nodes, grouped=False)
    return found.select(
        "query_id", "target_id", "chain_length", "diagonal", "chain_start_qpos", "region_len",
        S.round_to(F.col("blosum62_mean"), 4).alias("blosum62_mean"), "passed_chain", "rescued",
        _rank(F.desc("chain_length"), F.desc_nulls_last("blosum62_mean")))


@query
def ra_candidates_documents(spark, folder):
    """Lines that each document line passes against under the diagonal filter, with all copies."""
    nodes = _word_nodes(spark, folder)
    passes = quality.with_own_copies(nodes.frame.select(F.col("node").alias("id"), F.col("id").alias("query_id"), "copies"),
                                     seeds.diagonal_pass_counts(nodes).withColumnRenamed("node", "id"))
    return passes.filter("passes > 0").select("query_id", F.col("copies").alias("query_copies"), "passes")


@query
def triangular_pairs(spark, folder):
    """Screen order and the number of targets each query is compared with."""
    antigens = materialize(word_antigens(spark, folder).select("id", "ordinal", F.length("sequence").alias("length")))
    ranked = ordering.screen_rank(antigens)
    return ranked.select("id", "rank", (F.lit(antigens.count() - 1) - F.col("rank")).alias("targets"))


@query
def identical_copies(spark, folder):
    """Every antigen with the id that its sequence has in pairs, and the number of copies."""
    antigens = word_antigens(spark, folder)
    nodes = build_nodes(antigens).frame
    return antigens.select("id", "sequence").join(
        nodes.select("sequence", F.col("id").alias("class_id"), "copies"), "sequence").drop("sequence")


@query
def resume_pending(spark, folder):
    """Queries left when those with stored pairs are skipped."""
    nodes = _word_nodes(spark, folder)
    done = seeds.jaccard_counts(nodes).filter("others > 0").select("node")
    # copies of one sequence are a stored pair too
    return nodes.frame.filter("copies = 1").join(done, "node", "left_anti").select("id", "length")


# --- filter quality ------------------------------------------------------------------------

def _message_members(spark, folder) -> tuple[NodeSet, DataFrame]:
    """Distinct messages, and their numbers of antigens in each conversation (the family)."""
    nodes = _message_nodes(spark, folder)
    counted = message_antigens(spark, folder).groupBy("sequence", F.concat(F.lit("C"), "conv_id").alias("family")).agg(
        F.count("*").alias("n"))
    members = materialize(counted.join(nodes.frame.select("sequence", F.col("node").alias("id")), "sequence").select(
        "id", "family", "n"))
    return nodes, members


def _message_families(spark, folder) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members, the diagonal filter's pairs of sequences that share a conversation, and what all its pairs weigh."""
    nodes, members = _message_members(spark, folder)
    found = materialize(seeds.family_passes(nodes, members))
    pairs = found.filter("a_node IS NOT NULL").select(F.col("a_node").alias("query_id"), F.col("b_node").alias("target_id"))
    return members, pairs, found.filter("a_node IS NULL").select("weight")


def _message_passes(spark, folder) -> DataFrame:
    """Distinct messages with their copies and the messages that each passes against."""
    nodes, members = _message_members(spark, folder)
    if seeds._settled(nodes):
        counted = seeds.diagonal_pass_counts(nodes).withColumnRenamed("node", "id")
        return quality.with_own_copies(quality.id_copies(members), counted)
    pairs = seeds.diagonal_pairs(nodes).withColumnsRenamed({"q_node": "query_id", "t_node": "target_id"})
    return quality.pass_counts(members, pairs)


@query
def filter_quality(spark, folder):
    return quality.filter_quality(*_message_families(spark, folder)).select(
        "total_pairs", "expected_pairs", "passing_pairs", "true_positives", "false_negatives",
        "background_passing", "background_rejected",
        S.round_to(F.col("filter_rate"), 4).alias("filter_rate"),
        S.round_to(F.col("sensitivity"), 4).alias("sensitivity"))


@query
def family_sensitivity(spark, folder):
    members, pairs, _ = _message_families(spark, folder)
    return quality.family_sensitivity(members, pairs).withColumn("sensitivity", S.round_to(F.col("sensitivity"), 4))


@query
def pass_distribution(spark, folder):
    found = quality.passes_distribution(_message_passes(spark, folder))
    return found.withColumns({c: S.round_to(F.col(c), 4) for c in ("mean", "rejection_rate")})


@query
def pass_histogram(spark, folder):
    return quality.passes_histogram(_message_passes(spark, folder))


@query
def family_counts(spark, folder):
    return quality.family_counts(word_antigens(spark, folder).select(
        "id", F.regexp_extract("id", "^(D[0-9]+):", 1).alias("family")))


# --- screens ---------------------------------------------------------------------------------

@query
def screen_kmer(spark, folder):
    return _pairs_out(screen.screen_kmer(_item_nodes(spark, folder)))


@query
def screen_vectorized(spark, folder):
    return _pairs_out(screen.screen_batch(_item_nodes(spark, folder)))


@query
def screen_exhaustive(spark, folder):
    return _pairs_out(screen.screen_batch(_item_nodes(spark, folder), prefilter=False))


@query
def screen_kmer_documents(spark, folder):
    return _pairs_out(screen.screen_kmer(_word_nodes(spark, folder)))


@query
def screen_vectorized_messages(spark, folder):
    return _pairs_out(screen.screen_batch(_message_nodes(spark, folder)))


@query
def screen_vectorized_documents(spark, folder):
    return _pairs_out(screen.screen_batch(_word_nodes(spark, folder)))


@query
def live_query(spark, folder):
    """One sequence (the first benchmark item) against all document lines."""
    first = word_items(spark, folder).orderBy("ordinal").first()
    antigens = word_antigens(spark, folder)
    found = lookup.live_query(first["sequence"], build_nodes(antigens), antigens, max_evalue=C.EXPORT_MAX_EVALUE)
    return found.select(
        "rank", "target_id", "raw_score", S.round_to(F.col("bit_score"), 1).alias("bit_score"),
        _log_evalue(F.col("evalue")).alias("log_evalue"), "significance", "aligned_region_len",
        "target_length")


def word_items(spark, folder) -> DataFrame:
    """Benchmark items read word by word."""
    from crossmer.sources.tables import table
    return table(spark, folder, "benchmark").select(
        F.col("item_id").alias("ordinal"),
        Q.word_residues(F.translate("text", "\n", " ")).alias("sequence"))


# --- stored tables -----------------------------------------------------------------------------

def _stored_antigens(spark, folder) -> DataFrame:
    return tables.conform_antigens(item_antigens(spark, folder).select(
        "id", "sequence", F.col("sequence").alias("stripped"), F.lit(False).alias("tag_found")))


def _stored_pairs(spark, folder) -> DataFrame:
    return tables.conform_pairs(screen.screen_kmer(_item_nodes(spark, folder)))


@query
def antigen_scan(spark, folder):
    return word_antigens(spark, folder).select(
        "id", F.col("sequence").alias("stripped")).orderBy("id")


@query
def antigen_upsert(spark, folder):
    """Messages stored by conversation, replaced by the last line of the same-numbered document."""
    record = lambda frame, key: frame.select(
        key.cast("string").alias("id"), "ordinal", "sequence",
        F.col("sequence").alias("stripped"), F.lit(0).alias("tag_found"),
        F.length("sequence").alias("length"))
    messages = record(message_antigens(spark, folder), F.col("conv_id"))
    lines = record(word_antigens(spark, folder), F.col("doc_id"))
    empty = messages.drop("ordinal").limit(0)
    return tables.upsert(tables.upsert(empty, messages, "id", "ordinal"), lines, "id", "ordinal")


@query
def sim_insert_ignore(spark, folder):
    """Jaccard pairs stored first, two-pass pairs inserted without replacing them."""
    nodes = _word_nodes(spark, folder)
    stored = seeds.jaccard_pairs(nodes).withColumn("origin", F.lit("pass1"))
    new = seeds.two_pass_pairs(nodes, threshold=1.0).withColumn("origin", F.lit("pass2"))
    merged = tables.insert_ignore(
        stored, new.withColumn("n", F.lit(1)), ["a_node", "b_node"], "n")
    return _named(merged.withColumnsRenamed({"a_node": "q_node", "b_node": "t_node"}), nodes,
                  S.round_to(F.col("jaccard"), 6).alias("jaccard"), "origin")


@query
def store_stats(spark, folder):
    """Antigens, residues and pairs of antigens with a common chain, copies of one sequence included."""
    nodes = _word_nodes(spark, folder)
    antigens = word_antigens(spark, folder).select(F.length("sequence").alias("length"))
    own = nodes.frame.filter("copies > 1").select(F.expr("copies * (copies - 1) div 2").alias("pairs"))
    return tables.store_summary(antigens, seeds.chain_weights(nodes).unionByName(own))


@query
def completed_queries(spark, folder):
    return _stored_pairs(spark, folder).select("query_id").distinct()


@query
def query_similar(spark, folder):
    """Best partners of every stored antigen."""
    found = tables.top_partners(tables.partners(_stored_pairs(spark, folder), None))
    return found.select(
        "id", "rank", "partner_id", "raw_score", "bit_score",
        _log_evalue(F.col("evalue")).alias("log_evalue"), "query_length", "target_length",
        "aligned_region_len", "pc_composite_score", "detection_source", "significance")


@query
def export_pairs(spark, folder):
    rows = tables.export_rows(_stored_pairs(spark, folder), _stored_antigens(spark, folder))
    return rows.withColumn("log_evalue", _log_evalue(F.col("evalue"))).drop("evalue").orderBy(
        "log_evalue", "query_id", "target_id")
