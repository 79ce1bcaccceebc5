"""Files, store, full runs and registered queries."""

import csv
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from crossmer import cli, constants as C
from crossmer.operators import tables as T
from crossmer.plans.run import run_screen
from crossmer.sources import files
from crossmer.sources.store import ResultStore

A = "MWKRTLDEAYQNNPGFICHSVATLKEWDRGQYHPMS"
B = "MTTSRDYLWAEKQNVFGHICPPLMKAEYDWRTSGQN"
TAG = "MHHHHHHGSSG"


def families(seed, members=6, alone=150):
    """Random families (15 % of residues changed) and unrelated sequences, all tagged."""
    rng = random.Random(seed)
    draw = lambda n: "".join(rng.choice(C.AMINO_ACIDS) for _ in range(n))
    rows = [(f"lone{n}", draw(rng.randint(40, 120))) for n in range(alone)]
    for f in range(8):
        base = draw(70)
        rows += [(f"fam{f}_{m}", "".join(rng.choice(C.AMINO_ACIDS) if rng.random() < 0.15 else r for r in base))
                 for m in range(members)]
    return [(name, TAG + sequence) for name, sequence in rows]


def write(folder, name, text, encoding="utf-8"):
    path = os.path.join(folder, name)
    with open(path, "w", encoding=encoding, newline="") as f:
        f.write(text)
    return path


def load(spark, path, **options):
    rows = files.load_sequences(spark, path, **options).orderBy("ordinal").collect()
    return [(r["id"], r["sequence"]) for r in rows]


TWO = [("AG1", A), ("AG2", B)]


@pytest.mark.parametrize("name, text, encoding", [
    ("a.csv", f"name,sequence\nAG1,{A}\nAG2,{B}\n", "utf-8"),
    ("b.csv", f";name;sequence\n;AG1;{A}\n;AG2;{B}\n", "utf-8"),
    ("c.csv", f"name;sequence\nAG1;{A}\nAG2;{B}\n", "utf-8"),
    ("d.tsv", f"name\tsequence\nAG1\t{A}\nAG2\t{B}\n", "utf-8"),
    ("e.csv", f"name,sequence\r\nAG1,{A}\r\nAG2,{B}\r\n", "utf-8"),
    ("f.csv", f"name,sequence\nAG1,{A}\nAG2,{B}\n", "utf-8-sig"),
    ("g.csv", f"\n  \nname,sequence\nAG1,{A}\n\n,\nAG2,{B}\n", "utf-8"),
    ("h.csv", f"name,sequence\nAG1,{A}\nAG2,{B}\nSHORT,ACDEF\nBAD\n", "utf-8"),
    ("i.csv", f'foo,bar\n"AG1","{A}"\nAG2,"{B}"\n', "utf-8"),
    ("j.csv", f'name,note,sequence\nAG1,"x, y",{A}\nAG2,,{B}\n', "utf-8"),
    ("k.fasta", f">AG1 first > one\n{A[:10]}\n{A[10:]}\n\n>AG2\n{B}", "utf-8"),
    ("l.fa", f">AG1\r\n{A}\r\n>AG2 x\r\n{B}\r\n", "utf-8-sig"),
    ("m.faa", f"stray\n>AG1\n{A}\n>\nACDEFGHIKL\n>S\nACD\n>AG2\n{B}\n", "utf-8"),
])
def test_formats(spark, tmp_path, name, text, encoding):
    assert load(spark, write(tmp_path, name, text, encoding)) == TWO


def test_row_numbers_and_renaming(spark, tmp_path):
    path = write(tmp_path, "a.csv", f"name,sequence\nAG1,{A}\nAG1,{B}\n\n,{A}\nAG1,short\nAG1,{A}\n")
    assert [i for i, _ in load(spark, path)] == ["AG1", "AG1_3", "antigen_5", "AG1_7"]
    path = write(tmp_path, "b.fasta", f">AG1\n{A}\n>X\n{B}\n>AG1\n{B}\n>X\n{A}\n>AG1\n{A}\n")
    assert [i for i, _ in load(spark, path)] == ["AG1", "X", "AG1_dup1", "X_dup2", "AG1_dup3"]


def test_many_small_splits(spark, tmp_path):
    path = write(tmp_path, "a.csv", "name,sequence\n" + "".join(f"N{n},{A}\n" for n in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        rows = files.load_csv(spark, path, verbose=False).orderBy("ordinal").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r["ordinal"], r["id"]) for r in rows] == [(n + 2, f"N{n}") for n in range(3000)]


def test_blank_lead_and_quoted_line_breaks(spark, tmp_path):
    path = write(tmp_path, "lead.csv", "\n , \n" * 400 + f"name,sequence\nAG1,{A}\n")
    assert load(spark, path) == [("AG1", A)]
    rows = [("AG1", A[:20] + "\n" + A[20:]), ("AG\n2", B), ('A "3"', A), ("AG4", "short")] * 40
    rows = [(f"{i}#{n}", q) for n, (i, q) in enumerate(rows)]
    text = "name,sequence\n" + "".join(
        '"' + i.replace('"', '""') + f'","{q}"\n' if n % 2 else f'"{i}",{q}\n' if "\n" not in q and '"' not in i
        else '"' + i.replace('"', '""') + f'","{q}"\n' for n, (i, q) in enumerate(rows))
    text += f'AG5"a,b"c,{A}\nAG6"x,{B}\n'
    path = write(tmp_path, "quoted.csv", text)
    expected = [(n + 2, r[0].strip(), r[1]) for n, r in enumerate(csv.reader(io.StringIO(text))) if n]
    expected = [(n - 1, i, "".join(c for c in q if c.isalpha())) for n, i, q in expected]
    for size in ("134217728", "700"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        got = [(r["ordinal"], r["id"], r["sequence"]) for r in files.load_csv(
            spark, path, verbose=False).orderBy("ordinal").collect()]
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert got == [(n, i, q.upper()) for n, i, q in expected if len(q) >= 8 and set(q.upper()) <= set(C.AMINO_ACIDS)]


def test_limits_and_errors(spark, tmp_path, capsys):
    good = write(tmp_path, "a.csv", f"name,sequence\nAG1,{A}\n")
    assert load(spark, good, max_len=10) == []
    assert "no valid sequences" in capsys.readouterr().err
    assert load(spark, write(tmp_path, "e.csv", "")) == []
    with pytest.raises(FileNotFoundError):
        load(spark, str(tmp_path / "none.csv"))
    with pytest.raises(FileNotFoundError):
        load(spark, str(tmp_path / "none.fasta"))
    with pytest.raises(ValueError, match="not found"):
        load(spark, good, id_col="x", seq_col="sequence")
    assert load(spark, good, id_col="name") == [("AG1", A)]
    assert [*files.iter_csv(spark, write(tmp_path, "s.csv", "id,seq\nA,acd\nA,x\n,ACD\n"))] == [
        ("A", "ACD"), ("A", ""), ("", "ACD")]


def test_header_detection():
    assert files.detect_columns(["name", "sequence"]) == (0, 1)
    assert files.detect_columns(["", " Name ", "SEQ"]) == (1, 2)
    assert files.detect_columns(["foo", "bar"]) == (0, 1)
    with pytest.raises(ValueError, match="Could not detect"):
        files.detect_columns(["foo", "bar", "baz"])


def test_sniffing(spark, tmp_path):
    for mark in C.DELIMITERS:
        path = write(tmp_path, f"{ord(mark)}.csv", f"\nname{mark}sequence\nAG1{mark}{A}\n")
        assert files.sniff_delimiter(spark, path) == mark
    assert files.sniff_delimiter(spark, write(tmp_path, "none.csv", "abc\n")) == ","


def antigen_rows(spark, rows):
    return spark.createDataFrame(rows, "id string, sequence string, stripped string, tag_found boolean, ordinal long")


def pair_rows(spark, rows):
    return spark.createDataFrame([(q, t, 50, e, 20, 21, 20) for q, t, e in rows], (
        "query_id string, target_id string, raw_score int, evalue double, query_length int, "
        "target_length int, aligned_region_len int"))


def test_store(spark, tmp_path):
    with ResultStore(spark, str(tmp_path / "store")) as store:
        assert not store.exists() and store.antigen_count() == 0 and store.get_meta("x") is None
        store.upsert_antigens(antigen_rows(spark, [("a", A, A[11:], True, 0), ("b", B, B, False, 1)]))
        store.upsert_antigens(antigen_rows(spark, [("b", A, A, False, 0), ("b", B, B[5:], True, 1), ("c", A, "", True, 2)]))
        assert [tuple(r) for r in store.get_all_stripped().collect()] == [("a", A[11:]), ("b", B[5:]), ("c", "")]
        assert (store.antigen_count(), store.total_residues()) == (3, len(A) - 11 + len(B) - 5)

        store.insert_similarities(pair_rows(spark, [("a", "b", 1e-5), ("b", "c", 5.0)]))
        store.insert_similarities(pair_rows(spark, [("a", "b", 1e-9), ("b", "a", 1e-7), ("c", "a", 1e-3), ("a", "c", 20.0)]))
        stored = {(r["query_id"], r["target_id"]): r for r in store.similarities.collect()}
        assert len(stored) == store.similarity_count() == 5
        assert stored["a", "b"]["evalue"] == 1e-5
        row = stored["b", "a"]
        assert (row["bit_score"], row["consec_match_len"], row["consec_query_start"], row["pi_diff"]) == (0.0, 0, -1, None)
        assert {r[0] for r in store.completed_queries().collect()} == {"a", "b", "c"}
        found = store.query_similar("a").collect()
        assert [(r["partner_id"], r["evalue"]) for r in found] == [("b", 1e-7), ("c", 1e-3)]
        assert len(store.query_similar("a", top_n=1).collect()) == 1

        store.set_meta(last_run="x", n="1")
        store.set_meta(n="2")
        assert (store.get_meta("last_run"), store.get_meta("n")) == ("x", "2")

        out = str(tmp_path / "out.csv")
        assert store.export_csv(out) == 4
        parts = sorted(p for p in os.listdir(out) if p.endswith(".csv"))
        lines = [line for p in parts for line in open(os.path.join(out, p)).read().splitlines()]
        assert lines[0].split(",") == list(T.EXPORT_COLUMNS) and len(T.EXPORT_COLUMNS) == 23
        body = [line.split(",") for line in lines if not line.startswith("query_id")]
        assert [float(r[2]) for r in body] == sorted(float(r[2]) for r in body)
        assert all('""' not in line for line in lines)


def test_old_tables_get_defaults(spark, tmp_path):
    old = spark.createDataFrame([("a", "b", 7, 9, 9, 8)], (
        "query_id string, target_id string, raw_score int, query_length int, target_length int, aligned_region_len int"))
    old.write.parquet(str(tmp_path / "s/similarities/v000001"))
    row = ResultStore(spark, str(tmp_path / "s")).similarities.first()
    assert (row["bit_score"], row["evalue"], row["consec_target_end"], row["detection_source"]) == (0.0, 999.0, -1, None)


@pytest.mark.parametrize("backend", ["kmer", "vectorized"])
def test_run_resume_and_recall(spark, tmp_path, backend):
    data = families(3)
    path = write(tmp_path, "in.csv", ";name;sequence\n" + "".join(f";{n};{q}\n" for n, q in data))
    folder = str(tmp_path / "store")
    stats = run_screen(spark, path, folder, tag=TAG, backend=backend, verbose=False)
    store = ResultStore(spark, folder)
    assert stats["total_antigens"] == stats["tag_found"] == len(data)
    first = store.antigens.filter("id = 'fam0_0'").first()
    assert first["sequence"] == TAG + first["stripped"] and first["tag_found"] == 1
    pairs = {frozenset((r["query_id"], r["target_id"])) for r in store.similarities.collect()}
    planted = [n for n, _ in data if n.startswith("fam")]
    related = {frozenset((a, b)) for a in planted for b in planted if a < b and a[:4] == b[:4]}
    assert len(related & pairs) / len(related) > 0.9
    before = store.similarity_count()
    again = run_screen(spark, path, folder, tag=TAG, backend=backend, verbose=False)
    assert store.similarity_count() == before and again["total_pairs"] == 0
    assert store.get_meta("total_antigens") == str(len(data))


def test_unsupported_matrix(spark, tmp_path):
    with pytest.raises(ValueError, match="blosum62"):
        run_screen(spark, "x.csv", str(tmp_path / "s"), matrix="blosum80")


def test_command_line(spark, tmp_path, capsys):
    path = write(tmp_path, "in.csv", f"id,seq\nA1,{A}\nA2,{A[:30]}WWWW{A[30:]}\nA3,{'ILVM' * 9}\n")
    db = str(tmp_path / "db")
    cli.main(["run", "--input", path, "--db", db, "--backend", "kmer"])
    cli.main(["query", "--db", db, "--id", "A1"])
    cli.main(["query", "--db", db, "--seq", A.lower()])
    cli.main(["stats", "--db", db])
    cli.main(["export", "--db", db])
    cli.main(["help-scores"])
    cli.main([])
    out = capsys.readouterr().out
    assert "Similar pairs found: 2" in out and "very high" in out and "antigens: 3 with" in out and "First hit, A" in out
    assert "2 pairs written to" in out and "search with any sequence" in out and "Completed in" in out
    with pytest.raises(SystemExit):
        cli.main(["stats", "--db", str(tmp_path / "none")])
    assert [cli.duration(s) for s in (5, 90, 7200)] == ["5s", "1.5min", "2.0hr"]


SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SMALL), reason="driver tables not available")
def test_registered_queries_match_sql(spark):
    from crossmer.oracles import oracle_queries
    from crossmer.queries import all_queries
    from oracle_check import compare, connect
    sqls, registered = oracle_queries(), all_queries()
    assert set(sqls) <= set(registered)
    link = connect(SMALL)
    quick = ("clean_load", "load_stats", "kmer_sets", "jaccard_pair", "ka_params", "evalue", "isoelectric_point",
             "physchem_similarity", "kmer_jaccard_join", "two_pass_candidates", "ra_details", "contiguous_match",
             "filter_quality", "antigen_upsert", "sim_insert_ignore", "triangular_pairs")
    for name in quick:
        ok, text = compare(spark, link, name, registered[name], sqls[name], SMALL)
        assert ok, f"{name}: {text}"
