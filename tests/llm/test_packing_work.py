"""Work of a packing task for words it has not met."""

import collections
import itertools
import sys

import numpy as np
import pyarrow as pa

from labelforge.llm import packing

SYLLABLES = ["re", "tion", "é", "eau", "ing", "ß", "ön", "qu", "ç", "th", "À", "Ha", "ñra", "sh", "ìo", "ed"]


def new_words(count):
    return ["".join(x) for x in itertools.islice(itertools.product(SYLLABLES, repeat=4), count)]


def calls(work):
    """Calls of Python and C functions that ``work`` makes."""
    seen = collections.Counter()

    def count(_frame, event, _arg):
        seen[event] += 1
    sys.setprofile(count)
    try:
        work()
    finally:
        sys.setprofile(None)
    return seen["call"] + seen["c_call"]


def test_new_words_are_not_tokenized_one_by_one():
    encoder = packing.Encoder(packing.vocabulary(), packing.END)
    words = new_words(60_000)
    texts = [" ".join(words[i:i + 200]) for i in range(0, len(words), 200)]
    assert calls(lambda: packing.tokenize(texts, encoder)) < len(words) / 5


def test_words_of_letters_have_the_tokenizers_ids():
    encoder = packing.Encoder(packing.vocabulary(), packing.END)
    words = new_words(3 * packing.WORDS + 7) + ["a", "é" * 300, "x1", "I’ll", "'s", "ж", "ŁÓDŹ"] + new_words(5)
    number = encoder.numbers(pa.array(words))
    ids = [encoder.flat[encoder.begin[n]:encoder.begin[n] + encoder.size[n]].tolist() for n in number]
    assert ids == [encoder.tokenizer.encode(w, add_special_tokens=False).ids for w in words]
    again = encoder.numbers(pa.array(words))
    assert (again == number).all() and len(set(number)) == len(set(words)) == len(encoder.known) - 1


def test_words_without_ids_of_an_end_are_told_apart():
    encoder = packing.Encoder(packing.vocabulary(), packing.END)
    words = [w.lower().encode() for w in new_words(50)]
    want = encoder.encode_words(words)
    encoder.last[:] = False
    assert all((a == b).all() for a, b in zip(want, encoder.encode_words(words)))


def test_parts_without_letters_and_without_words():
    encoder = packing.Encoder(packing.vocabulary(), packing.END)
    for texts in ([""], [" \n", "", "\t"], ["12 .,", "", "…"], ["éa", "b"]):
        ids, counts, keys = packing.tokenize(texts, encoder)
        want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids + [packing.END] for t in texts]
        assert [list(x) for x in np.split(ids, np.cumsum(counts)[:-1])] == want
        assert len(keys) == len(texts)
