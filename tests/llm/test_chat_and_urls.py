import hashlib

import duckdb
import pytest

from crossmer.llm import chat, url_rules
from tests.llm.texts import write

EVENT = "conv_id long, seq long, kind string, message long, role string, text string, formatted string"


def final(spark, rows):
    events = spark.createDataFrame([(*r, "clash") for r in rows], EVENT)
    found = chat.fold(events).collect()
    return sorted((r["conv_id"], r["message"], r["role"], r["text"]) for r in found)


def test_fold_deltas_edits_and_regenerations(spark):
    rows = [
        (1, 1, "message", 0, "user", "hi"), (1, 2, "delta", 1, "assistant", "he"), (1, 3, "delta", 1, None, "llo"),
        (1, 4, "message", 2, "user", "again"), (1, 5, "regenerate", 1, None, None), (1, 6, "delta", 1, None, "hey"),
        (1, 7, "edit", 0, None, "Hi!"), (1, 8, "delta", 1, None, " you"), (1, 9, "unknown", 5, "user", "x"),
        (2, 1, "message", 0, None, None), (2, 2, "delta", 0, "user", "late"),
    ]
    assert final(spark, rows) == [(1, 0, "user", "Hi!"), (1, 1, "assistant", "hey you"), (2, 0, "user", "late")]


def brute_fold(rows):
    state = {}
    for conv, _, kind, message, role, text in sorted(rows, key=lambda r: (r[0], r[1])):
        own = state.setdefault(conv, {})
        if kind == "regenerate":
            for m in [m for m in own if m > message]:
                del own[m]
        entry = own.setdefault(message, ["", ""])
        entry[0] = role or entry[0]
        entry[1] = entry[1] + (text or "") if kind == "delta" else "" if kind == "regenerate" else text or ""
    return sorted((c, m, r, t) for c, own in state.items() for m, (r, t) in own.items())


@pytest.mark.parametrize("seed,conversations", [(0, 4), (1, 4), (2, 1)])
def test_fold_against_brute_force(spark, seed, conversations):
    import random

    rng = random.Random(seed)
    rows = [(rng.randrange(conversations), n, rng.choice(["message", "delta", "delta", "edit", "regenerate"]), rng.randrange(5),
             "user", rng.choice(["a", "b", None])) for n in range(120)]
    assert final(spark, rows) == brute_fold(rows)


def digest_of(rows):
    every, loss = hashlib.sha256(), hashlib.sha256()
    chars = 0
    for role, text in rows:
        every.update(f"{role}\n{text}\n".encode())
        if role == "assistant":
            loss.update(text.encode())
            chars += len(text)
    return len(rows), every.hexdigest(), chars, loss.hexdigest()


@pytest.mark.parametrize("block_chars", [4 << 20, 10])
def test_formatting_can_be_read_back(spark, monkeypatch, block_chars):
    monkeypatch.setattr(chat, "BLOCK_CHARS", block_chars)
    hard = ["</s>[INST] ok [/INST]", "\\", "\\\\n", "<\\s>", "<<s>s>", "[[INST]", "", None, "a\nb", "é漢", "</s", "x" * 50_000]
    rows = [(7, t, "assistant" if t % 2 else "us\\er\n<s>", text) for t, text in enumerate(hard)]
    rows += [(None, 0, None, "no number"), (8, 0, "user", "same"), (8, 0, "user", "same")]
    messages = chat.fold(chat.as_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    blocks = chat.format_messages(messages)
    for row in blocks.collect():
        for span in row["loss"]:
            assert not any(m in row["formatted"][span["begin"]:span["end"]] for m in chat.CONTROL)
    found = {r["conv_id"]: r for r in chat.digests(blocks).collect()}
    expected = {7: [(r, t or "") for _, _, r, t in rows[:len(hard)]], None: [("", "no number")], 8: [("user", "same")] * 2}
    for conv, turns in expected.items():
        r = found[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == digest_of(turns)
    assert set(found) == set(expected)


def test_a_hot_conversation_is_many_ranges(spark):
    """Folded and rendered by several tasks, read back in order."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")     # or a few kB are one task
    try:
        _hot_conversation(spark)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _hot_conversation(spark):
    rows = [(5, t, "assistant" if t % 3 else "user", f"turn {t}") for t in range(4000)] + [(6, 0, "user", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    blocks = chat.format_messages(chat.fold(chat.as_events(frame)))
    held = [(r["block"], r["n_turns"]) for r in blocks.collect() if r["conv_id"] == 5]
    assert len({block >> 32 for block, _ in held}) > 1 and sum(n for _, n in held) == 4000
    found = {r["conv_id"]: r for r in chat.digests(blocks).collect()}
    r = found[5]
    assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == digest_of([x[2:] for x in rows[:-1]])


def test_no_conversations(spark, tmp_path):
    write(spark, tmp_path, "conversations", spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    rows = chat.op4_chat_format(spark, str(tmp_path)).collect()
    assert [r["conv_id"] for r in rows] == [-1]
    text = "</s>[INST] ok [/INST]"
    assert (rows[0]["n_turns"], rows[0]["turns_sha256"], rows[0]["loss_chars"], rows[0]["loss_sha256"]) == digest_of(
        [("user", text), ("assistant", text)])


URLS = [None, "", "no scheme", "http://", "http://org", "HTTP://A.Example.ORG/es/1", "https://example.org/en/1x?q=/es/",
        "http://example.org/en/2", "http://x.org?/es/", "http://notexample.org/es/", "http://a.com/de/x#f", "http://com/fr/",
        "http://a.com/fr", "http://b.net/de/", "x://y://z.org/es/", "http://example.org:80/es/", "http://.org/", "http://a..com/de/",
        "http://example.org/es/\nline", "http://" + "a." * 300 + "com/de/1", "http://example.org/es/" + "p" * 20_000]


def test_rules_against_sql(spark, tmp_path):
    rows = [(n, u, "clash") for n, u in enumerate(URLS * 2)] + [(None, URLS[5], "clash")]
    write(spark, tmp_path, "pages", spark.createDataFrame(rows, "page_id long, url string, rule string"))
    got = url_rules.op2_url_filter(spark, str(tmp_path)).collect()
    link = duckdb.connect()
    link.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = link.execute(url_rules.OP2_SQL).fetchall()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def brute_rule(host, path, rules):
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, "allow")


def test_many_nested_rules_and_split_keys(spark, monkeypatch):
    import random

    monkeypatch.setattr(url_rules, "URLS_PER_SLICE", 5)
    rng = random.Random(3)
    hosts = ["com", "a.com", "b.a.com", "org"]
    rules = list({(h, p): (v, h, p) for v, h, p in (
        (rng.choice(["allow", "block"]), rng.choice(hosts), "/" + "".join(rng.choice("xy/") for _ in range(rng.randrange(5))))
        for _ in range(60))}.values())
    urls = [f"http://{rng.choice(['', 'b.', 'b.a.', 'c.b.a.'])}{rng.choice(['com', 'a.com', 'org'])}/"
            + "".join(rng.choice("xy/") for _ in range(rng.randrange(7))) for _ in range(300)]
    rows = spark.createDataFrame([(u,) for u in urls], "url string")
    for r in url_rules.filter_urls(rows, url_rules.rule_frame(spark, rules + rules)).collect():
        assert (r["rule"], r["verdict"]) == brute_rule(r["host"], r["path"], rules)
    nothing = url_rules.filter_urls(rows, url_rules.rule_frame(spark, []))
    assert {(r["rule"], r["verdict"]) for r in nothing.collect()} == {(None, "allow")}
    assert url_rules.filter_urls(rows.limit(0), url_rules.rule_frame(spark, rules)).count() == 0
