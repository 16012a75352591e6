"""Encoder: pre-tokens reach Python as bytes without Arrow's slow lists, and ids are the library's, also from the older generation of the cache."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from keelgrid.llm import tokens, tokenstore


def test_ids_and_no_arrow_lists(monkeypatch):
    own = tokens.Encoder(tokenstore.VOCABULARY)
    texts = ["Über den Wolken 12,5 km", "", " \n", "one two two three", "l'été", "été one"]
    want = [np.array(own.library.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    asked, real = [], pa.Array.from_buffers

    class Units:
        def __init__(self, array):
            self.array = array

        def dictionary_encode(self):
            done = self.array.dictionary_encode()

            class Seen:
                indices = done.indices

                @property
                def dictionary(self):
                    asked.append(1)
                    return Words(done.dictionary)

            return Seen()

    class Words:
        def __init__(self, array):
            self.array = array

        def to_pylist(self):
            raise AssertionError("Arrow's list")

        def __getattr__(self, name):
            return getattr(self.array, name)

    class Fake:
        @staticmethod
        def from_buffers(*a, **k):
            return Units(real(*a, **k))

    monkeypatch.setattr(tokens.pa, "Array", Fake)
    assert own.encode(texts) == want and asked
    own.cache, own.older = {}, own.cache
    assert own.encode(texts) == want
