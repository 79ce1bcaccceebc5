import numpy as np
import pytest

from crossmer.llm import language_id
from tests.llm.texts import DOCUMENTS, write

WORDS = {
    "en": "the and of with that this from where house water people morning",
    "de": "der und mit das nicht haus wasser morgen straße schön über für",
    "fr": "le et avec que pas maison eau matin très être où garçon",
}


def sentence(language, seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS[language].split(), n))


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(k, sentence(l, k, 40), l, f"host-{l}", 0, "", "", "", "") for k, l in enumerate(list(WORDS) * 20)]
    return spark.createDataFrame(rows, DOCUMENTS)


@pytest.fixture(scope="module")
def models(labelled):
    return language_id.fit_text_models(labelled)


def test_models_count_whole_texts(labelled, models):
    assert models.languages == sorted(WORDS)
    raw = [r["text"].encode() for r in labelled.filter("lang = 'de'").collect()]
    counts = np.bincount(language_id.triplets(raw)[0], minlength=language_id.BUCKETS)
    expected = language_id.TextModels(["de"], counts[None, :].astype(float))
    assert np.allclose(expected.logs[:, 0], models.logs[:, models.languages.index("de")])


def test_triplets_against_plain_loops():
    texts = ["Ab c", "", "ß-x", "A"]
    hashed, bounds = language_id.triplets([t.encode() for t in texts])
    for k, text in enumerate(texts):
        data = [32, *(int(language_id._LETTER[b]) for b in text.encode()), 32]
        want = [((a << 16 | b << 8 | c) * 2654435761 % 2**32) >> 16 for a, b, c in zip(data, data[1:], data[2:]) if b != 32]
        assert hashed[bounds[k]:bounds[k + 1]].tolist() == want


def test_odd_documents(spark, models):
    rows = [
        (1, sentence("en", 900, 50), "en", "a", 0, "", "", "", ""), (2, sentence("de", 901, 50), None, None, 0, "", "", "", ""),
        (3, "", "fr", "a", 0, "", "", "", ""), (4, None, None, None, 0, "", "", "", ""), (5, "12 34 !!", "en", "a", 0, "", "", "", ""),
        (None, sentence("fr", 902, 50), "xx-YY", "a", 0, "", "", "", ""), (6, sentence("fr", 903, 90_000), "de", "a", 0, "", "", "", ""),
        (1, sentence("en", 900, 50), "en", "a", 0, "", "", "", ""), (7, "漢字かな交じり文 " * 40, "ja", "b", 0, "", "", "", ""),
    ]
    documents = spark.createDataFrame(rows, DOCUMENTS)
    found = language_id.identify_documents(documents, models).collect()
    assert len(found) == len(rows)
    by_id = {}
    for r in found:
        by_id.setdefault(r["id"], []).append(r)
    assert [len(by_id[i]) for i in (1, 2, None)] == [2, 1, 1]
    assert {i: by_id[i][0]["language"] for i in (1, 2, 6, None, 7)} == {1: "en", 2: "de", 6: "fr", None: "fr", 7: "und"}
    assert [by_id[i][0]["accepted"] for i in (1, 3, 4, 5, 7)] == [True, False, False, False, False]
    kept = language_id.accepted_documents(documents, models)
    assert kept.columns == documents.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "1", "2", "6", "None"]


def test_priors_and_markup_decide_short_texts(spark, models):
    pages = [(n, f"http://www.site.example/{n}", f"<html><body>{sentence('de', n, 30)}</body></html>") for n in range(60)]
    pages += [(100, "http://www.site.example/x", "<html><p>so</p></html>"), (101, "http://other.fr/x", "<html><p>so</p></html>"),
              (102, "http://lone.example/x", '<HTML class="a" LANG=fr-CA><script>the and of</script>et avec</html>'), (103, None, None)]
    found = {r["id"]: r for r in language_id.identify_pages(
        spark.createDataFrame(pages, "page_id long, url string, html string"), models).collect()}
    assert [found[n]["language"] for n in (0, 100, 102)] == ["de", "de", "fr"]
    assert found[103]["accepted"] is False and found[100]["accepted"] is True


def test_fused_evidence_against_brute_force(spark, models):
    rng = np.random.default_rng(1)
    hosts = ["a.x.de", "b.x.de", "y.fr", "z", ""]
    rows = [(n, rng.choice(hosts), sentence(rng.choice(list(WORDS)), n, int(rng.integers(1, 4))), rng.choice(["en", "de", "zz"]))
            for n in range(40)]
    frame = spark.createDataFrame([(int(n), str(d), str(h), h.rsplit(".")[-1] if "." in h else "", str(t)) for n, h, t, d in rows],
                                  "id long, declared string, host string, suffix string, text string")
    found = {r["id"]: r for r in language_id.fuse(language_id.text_evidence(frame, models), models.languages).collect()}
    names, width = [*models.languages, "und"], len(models.languages) + 1
    means, sizes = models.score([t for _, _, t, _ in rows])
    logs = means * np.minimum(sizes, language_id.FULL_WEIGHT)[:, None]
    parts = np.exp(logs - logs.max(1, keepdims=True))
    parts = parts / parts.sum(1, keepdims=True) * (sizes > 0)[:, None]
    suffix = lambda h: h.rsplit(".")[-1] if "." in h else ""
    domain = lambda h: ".".join(h.split(".")[-2:])
    for k, (n, host, _, declared) in enumerate(rows):
        prior = np.array([(1 - language_id.UNKNOWN_PRIOR) / (width - 1)] * (width - 1) + [language_id.UNKNOWN_PRIOR])
        for level in (lambda h: 0, suffix, domain, lambda h: h):
            rest = sum(parts[j] for j in range(len(rows)) if level(rows[j][1]) == level(host)) - parts[k]
            prior = (rest + language_id.PRIOR_ROWS * prior) / (rest.sum() + language_id.PRIOR_ROWS)
        total = logs[k] + np.log(prior)
        for named, sure in ((declared, language_id.RELIABILITY),
                            (language_id.SUFFIX_LANGUAGES.get(suffix(host)), language_id.SUFFIX_RELIABILITY)):
            if named in names[:-1]:
                total += np.log(np.where(np.array(names) == named, sure, (1 - sure) / (width - 1)))
        posterior = np.exp(total - total.max())
        posterior /= posterior.sum()
        assert found[n]["language"] == names[int(posterior.argmax())]
        assert found[n]["probability"] == pytest.approx(posterior.max(), rel=1e-6)


def test_empty_tables(spark, tmp_path):
    write(spark, tmp_path, "documents", spark.createDataFrame([], DOCUMENTS))
    write(spark, tmp_path, "pages", spark.createDataFrame([], "page_id long, url string, html string"))
    assert language_id.op8_language_id(spark, str(tmp_path)).count() == 0
    assert language_id.op8_language_id_pages(spark, str(tmp_path)).count() == 0


def test_rows_are_accepted_by_their_own_text(spark, models):
    rows = [(1, sentence("en", 5, 50)), (1, "漢字かな交じり文 " * 40), (None, sentence("de", 6, 50)), (None, "漢字かな " * 40), (2, None)]
    documents = spark.createDataFrame([(i, t, None, None, 0, "", "", "", "") for i, t in rows], DOCUMENTS)
    kept = language_id.accepted_documents(documents, models).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted([rows[0], rows[2]], key=str)


def test_a_rare_language_is_modelled_at_any_size(spark):
    """Five German rows (as many as MIN_DOCUMENTS) among 6,000 English ones, with a sample of 200."""
    rows = [(k, sentence("en", k, 12), "en", "h", 0, "", "", "", "") for k in range(6000)]
    rows += [(10_000 + k, sentence("de", k, 40), "de", "h", 0, "", "", "", "") for k in range(4)]
    rows += [(None, sentence("de", 9, 40), "de", "h", 0, "", "", "", ""), (20_000, sentence("fr", 1, 40), "fr", "h", 0, "", "", "", "")]
    documents = spark.createDataFrame(rows, DOCUMENTS)
    models = language_id.fit_text_models(documents, 200)
    assert models.languages == ["de", "en"]
    raw = [r["text"].encode() for r in documents.filter("lang = 'de'").collect()]
    counts = np.bincount(language_id.triplets(raw)[0], minlength=language_id.BUCKETS)
    expected = language_id.TextModels(["de"], counts[None, :].astype(float))
    assert np.allclose(expected.logs[:, 0], models.logs[:, 0])
    found = language_id.identify_documents(documents.filter("lang = 'de'"), models).collect()
    assert [r["language"] for r in found] == ["de"] * 5
