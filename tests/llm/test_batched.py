"""Word decisions and page trees made in bulk agree with those made one by one."""

import numpy as np

from labelforge.llm import html_text, toxicity

TEXTS = ["a plain text", None, "", "i d i o t and x_y", "noon level 2020 été", "word " * 300, "z" * 60, "(...) --"]


def test_texts_together_score_as_alone(monkeypatch):
    weight = np.random.default_rng(3).normal(size=toxicity._CODES ** 3)
    together = toxicity.Decider(toxicity.ToxicModel(weight, 0.1)).features(TEXTS)
    alone = [toxicity.Decider(toxicity.ToxicModel(weight, 0.1)).features([t])[0] for t in TEXTS]
    assert np.allclose(together, alone)
    monkeypatch.setattr(toxicity, "GROUP", 1)
    monkeypatch.setattr(toxicity, "CACHE", 2)
    assert np.allclose(toxicity.Decider(toxicity.ToxicModel(weight, 0.1)).features(TEXTS), together)
    assert toxicity.Decider(toxicity.ToxicModel(weight, 0.1)).features([]).shape == (0, 3)


def test_norms_with_and_without_repeated_letters():
    for word in ("abcdef", "banana", "x", "aa"):
        (_, keys, weight, norm), = toxicity.word_map([word])
        sums: dict = {}
        for k, w in zip(keys[0], weight):
            sums[k] = sums.get(k, 0.0) + w
        assert np.isclose(norm[0] ** 2, sum(v * v for v in sums.values()))


def test_texts_that_speak_for_words(spark):
    rows = [(i, "often") for i in range(60)] + [(100 + i, "rare") for i in range(3)] + [(5, "rare")]
    held = spark.createDataFrame(rows, "doc_id long, word string")
    assert sorted(map(tuple, toxicity.speaking(held, 100).collect())) == sorted(rows)
    got = {tuple(r) for r in toxicity.speaking(held, 10, 4).collect()}
    docs = {d for d, _ in got}
    assert {100, 101, 102, 5} <= docs and len(docs) < 20
    assert got == {r for r in rows if r[0] in docs}


def test_tree_without_hashes_gives_the_same_text():
    page = ('<body><nav>menu</nav><main><h1>T &amp; t</h1><p>one  two<br>three<div class="share-buttons">x</div>'
            '<ul><li>a<li>b</ul><table><tr><td>c<td>d</table></main></body>')
    whole, bare = html_text.parse(page), html_text.parse(page, False)
    assert html_text.main_text(whole, set()) == html_text.main_text(bare, set()) == "T & t\none two\nthree\na\nb\nc\nd"
    assert whole.hash and not bare.hash and whole.prose == bare.prose and whole.longest == bare.longest
