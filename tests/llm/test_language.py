import numpy as np

from speechtables.llm import language
from speechtables.llm.common import read_table
from tests.llm.helpers import odd_texts

ROWS = "doc_id bigint, text string, lang string, lang_pred string"


def test_probabilities_of_every_context_sum_to_one():
    grams = np.concatenate([language.grams_of(language.symbols_of(t)) for t in ("banana bandana", "cab ban nab", "can't")])
    model = language.fit_model(*np.unique(grams, return_counts=True))
    for context in ("", "ban", "zzz", "an", "b"):
        symbols = [0, 0, 0, *language.symbols_of(context)[:-1].tolist()][-3:]
        keys = np.array([int("".join(f"{s:06b}" for s in symbols), 2) << 6 | x for x in range(64)], np.int32)
        assert np.isclose(np.exp(model.log_probability(keys)).sum(), 1)


def test_counts_and_continuations_by_hand():
    grams = language.grams_of(language.symbols_of("ab ab"))
    # symbols a b . a b . ; grams ...a ..ab .ab. ab.a b.ab .ab.
    assert language.symbols_of("ab, ab!").tolist() == [1, 2, 0, 1, 2, 0]
    keys, counts = np.unique(grams, return_counts=True)
    assert counts.sum() == 6 and counts.max() == 2
    model = language.fit_model(keys, counts)
    once, twice = 4, 1
    discount = once / (once + 2 * twice)
    key = grams[2]  # .ab -> boundary, always
    at = np.searchsorted(model.keys[3], key)
    lower = np.exp(model.logs[2][np.searchsorted(model.keys[2], key & ((1 << 18) - 1))])
    assert np.isclose(np.exp(model.logs[3][at]), (2 - discount) / 2 + discount * 1 / 2 * lower)


def test_scores_equal_sums_over_symbols():
    models = [language.fit_model(*np.unique(language.grams_of(language.symbols_of(t)), return_counts=True)) for t in ("the cat sat", "le chat dort")]
    scorer = language._Scorer(language.Identifier(("en", "fr"), tuple(models)))
    texts = ["the chat", None, "", "123", "été sat"]
    for _ in range(2):
        sums, size = scorer(texts)
        for i, text in enumerate(texts):
            grams = language.grams_of(language.symbols_of(text))
            assert size[i] == len(grams)
            assert np.allclose(sums[i], [m.log_probability(grams).sum() if len(grams) else 0 for m in models])


def test_held_out_accuracy(spark):
    table = read_table(spark, "/root/testdata/sf0.01", "documents")
    rows = language.languages_of(table).join(table.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == table.count() and len(held) > 200
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.98
    right = np.mean([r["score"] for r in held])
    assert abs(right - np.mean([r["lang"] == r["lang_pred"] for r in held])) < 0.05


def test_odd_rows(spark):
    texts = odd_texts()
    rows = [(i, t, "en" if i % 2 else None, "z") for i, t in enumerate(texts)] + [(None, "le chat dort ici", "fr", "z"), (50, "le chat dort ici bas", "fr", "z")]
    found = language.languages_of(spark.createDataFrame(rows, ROWS)).collect()
    by_id = {r["doc_id"]: r for r in found}
    assert len(found) == len(rows)
    for i in (0, 1, 2):
        assert (by_id[i]["lang_pred"], by_id[i]["score"]) == ("und", 0.0)
    assert by_id[3]["score"] == by_id[4]["score"] and all(0 <= r["score"] <= 1 for r in found)
    assert by_id[None]["held_out"] is False
    assert language.languages_of(spark.createDataFrame([], ROWS)).count() == 0
    nothing = spark.createDataFrame([(1, "some words", None, "z")], ROWS)
    assert [r["lang_pred"] for r in language.languages_of(nothing).collect()] == ["und"]
