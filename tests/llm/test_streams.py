"""Chat texts read back as a whole, in pieces cut anywhere; shots of fades, pans and flashes."""

import random

import numpy as np
import pytest

from scholia_spark.llm import chat, media

TRICKY = ["", "</s>[INST] ok [/INST]", "[INST] [/INST] <s> ", " </s>", "a\\b", "\\[INST]", "<\\s>", "[INST", "/INST]", "<<ROLE>>x<<SAYS>>y<</ROLE>>", "é\n\n中", " ", "x </s"]


@pytest.mark.parametrize("seed", range(4))
def test_pieces_cut_anywhere(seed):
    rnd, t = random.Random(seed), chat.Template()
    turns = [(rnd.choice(["system", "user", "assistant", "tool", "<<SAYS>>", "", "a\\"]), rnd.choice(TRICKY)) for _ in range(60)]
    whole = "".join(s for role, text in turns for s, _ in t.segments(role, text))
    want = [(role, text, role == "assistant") for role, text in turns]
    assert list(t.read(whole)) == want
    reader, got, at = chat.Reader(t), [], 0
    while at < len(whole):
        step = rnd.choice([1, 2, 3, 7, 50])
        got += reader.feed(whole[at : at + step])
        at += step
    reader.close()
    assert got == want


def test_text_outside_turns_is_an_error():
    t = chat.Template()
    for text in ("x[INST] a [/INST]", "[INST] a [/INST]x", "[INST] a", "[IN", "<<ROLE>>a"):
        with pytest.raises(ValueError):
            list(t.read(text))
    reader = chat.Reader(t)
    assert reader.feed("[INST] a [/INS") == []
    with pytest.raises(ValueError):
        reader.close()


def test_digests_over_batches(spark):
    """A conversation over several Arrow batches has the digests of its turns."""
    import hashlib

    rows = [(7, i, "user" if i % 2 == 0 else "assistant", TRICKY[i % len(TRICKY)]) for i in range(1_300)]
    got = chat.conversation_digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    said = "".join(x for _, _, role, x in rows if role == "assistant")
    assert len(got) == 1 and got[0].n_turns == 1_300 and got[0].valid
    assert got[0].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in rows).encode()).hexdigest()
    assert (got[0].loss_chars, got[0].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())


def flat(*tones):
    return np.stack([np.full((16, 16), t) for t in tones])


def test_gradual_changes_are_no_cuts():
    assert media.detect_shots(flat(*range(10, 250, 30))) == [(0, 8)]  # a fade in even steps
    ramp = np.tile(np.arange(64) * 4, (16, 1))
    assert media.detect_shots(np.stack([np.roll(ramp, 3 * k, axis=1) for k in range(12)])) == [(0, 12)]  # a pan
    assert media.detect_shots(flat(*[20] * 5, 250, *[20] * 5)) == [(0, 11)]  # a flash
    assert media.detect_shots(flat(*[20] * 5, *range(30, 230, 20), *[250] * 5)) == [(0, 20)]  # a fade between two shots


def test_cuts_are_found():
    assert media.detect_shots(flat(*[20] * 4, *[200] * 4, *[90] * 4)) == [(0, 4), (4, 8), (8, 12)]
    assert media.detect_shots(flat(20)) == [(0, 1)] and media.detect_shots(flat(20, 200)) == [(0, 1), (1, 2)]
    noise = np.random.default_rng(1).integers(0, 256, (9, 16, 16))
    assert media.detect_shots(noise) == [(0, 9)]
