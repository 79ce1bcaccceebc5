"""Small tables for the tests."""

import random

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, sig string, n string, length string, value string"


def prose(seed, n_words, vocabulary=400):
    rng = random.Random(seed)
    syllables = ["an", "er", "th", "on", "ti", "re", "sh", "ou", "in", "ed", "be", "lo"]
    words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(vocabulary)]
    out = [rng.choice(words) for _ in range(n_words)]
    return " ".join(w.capitalize() + "." if i % 11 == 0 else w for i, w in enumerate(out))


def near(text, seed, changes):
    rng = random.Random(seed)
    words = text.split(" ")
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"new{rng.randrange(1000)}"
    return " ".join(words)


def frame(spark, rows):
    """documents of (doc_id, text) with further columns whose names clash with inner ones."""
    full = [(i, t, "en", "src0", len(t or ""), "x", "y", "z", None) for i, t in rows]
    return spark.createDataFrame(full, DOCUMENTS)


def odd(spark):
    """Nulls, empty and blank texts, repeated rows, a very long text, equal ids."""
    long_text = prose(5, 60_000)
    return frame(spark, [
        (None, None), (None, "some words of no document"), (1, ""), (1, ""), (2, None), (3, " \n\t "), (4, "word"),
        (5, "five short words are here"), (5, "other text under the same number"), (6, long_text), (7, long_text),
        (8, "Ünïcode ß ∑ 漢字 \x1c <|endoftext|> 's 'T"), (9, prose(9, 300)), (10, near(prose(9, 300), 1, 4)),
    ])


def write(spark, folder, name, rows):
    rows.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
