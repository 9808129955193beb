"""Words cut into parts for the token files, against the vocabulary's library on whole texts."""

from __future__ import annotations

import random
import unicodedata

import numpy as np
import pyarrow as pa

from exposia.llm import queries
from exposia.llm.token_files import _LETTER, VOCABULARY, WordEncoder, kinds_of, parts

WORDS = f"{queries.TOKENIZERS}/{VOCABULARY}"


def test_encoder_cuts_words_without_changing_ids():
    """Parts of words give the ids of whole texts, marks, odd letters and special strings included; few parts are encoded."""
    rng, encoder = random.Random(5), WordEncoder(WORDS)
    bits = [*"abKHTWYJIı.,;!?'\"|<>/0123 \t", "'s", "'LL", "É", "é", "İ", "ǰ", "ß", "×", "÷", "\u0301", "\u0307", "\u030a", "\u0331", "\u0338", "Σ", "中", "\u00a0",
            "’", "ﬁ", "😀", "\x1c", "\x00", "<|endoftext|>", "<|EndOfText|>", "<|startoftext|>", "ȿ", "ɐ", "ʃ", "K", "word", "Word"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(0, 30))) for _ in range(4000)]
    texts += [f"{a}{b}" for a in bits for b in bits] + [None, ""]
    for some in (texts, texts[::-1]):  # known and unknown parts in either order
        ids, count = encoder(pa.array(some))
        ends = np.cumsum(count)
        got = [ids[e - n : e - 1].tolist() for e, n in zip(ends, count)]
        assert got == [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in some]
        assert (ids[ends - 1] == 1).all()
    for c in map(chr, range(0xC0, 0x280)):  # taken for letters: one letter each after the normaliser
        if (kinds_of(np.frombuffer(c.encode(), np.uint8)) == _LETTER).all():
            low = unicodedata.normalize("NFC", c).lower()
            assert len(low) == 1 and unicodedata.category(low)[0] == "L"
    data = np.frombuffer("Les, les. LES! (été) l'été 42".encode(), np.uint8)
    starts, ends, owner, letters, low = parts(data, np.array([0, len(data)]))
    found = [low[a:b].tobytes().decode() for a, b in zip(starts, ends)]
    assert found == ["les", ",", "les", ".", "les", "!", "(", "été", ")", "l", "'été", "4", "2"]
    assert letters.tolist() == [x.isalpha() for x in found]
