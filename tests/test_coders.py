import lzma
import math
import random
from fractions import Fraction

import pytest

from quillbit.functions import symbols as S
from quillbit.operators import coder as C
from quillbit.operators import sequential as M
from quillbit.operators.urns import Blending, Exclusion, Gradient, SeatingCRP, SequenceMemoizer, UrnPPM
from quillbit.plans.score import codec, compress, decompress, measure, traces
from quillbit.plans.spec import BASES, LAYERS, grid_names, named, parse, parse_part

TEXTS = [b"", b"a", b"abracadabra " * 20, "naïve 😀 ключ κόσμε".encode() * 3, bytes(range(256)), b"\xed\xa0\x80\xc0\xaf\xff" * 4]

STACKS = [(layer, base) for base in BASES if base != "lzw_byte" for layer in ("none", "crp:a=1:b=0.25", "ppm:d=3", "lzwEscape")] + [
    ("none", "lzw_byte"), ("lzw", "uniform_byte"), ("ppm:d=0", "uniform_byte"), ("ppm:d=6:a=0.095:b=0.409", "polya_byte"),
]


@pytest.mark.parametrize("layer,base", STACKS)
def test_round_trip(layer, base):
    spec = parse(layer, base)
    for text in TEXTS:
        if len(text) > 100 and base not in ("uniform_byte", "lzw_byte"):
            text = text[:100]
        packed = compress(text, spec)
        assert decompress(packed, spec) == text
        assert len(packed) == -(-measure(text, spec) // 8)


def test_coder_is_close_to_ideal():
    rng = random.Random(3)
    sink = C.BitBuffer()
    enc, ideal, told = C.Encoder(sink), 0.0, []
    for _ in range(2000):
        total = rng.randrange(2, 5000)
        lo = rng.randrange(total)
        hi = rng.randrange(lo + 1, total + 1)
        enc.narrow(lo, hi, total)
        told.append((lo, hi, total))
        ideal -= math.log2((hi - lo) / total)
    enc.finish()
    assert ideal - 1 <= sink.n <= ideal + 2
    dec = C.Decoder(C.bits_of(bytes(sink)))
    for lo, hi, total in told:
        assert lo <= dec.target(total) < hi
        dec.narrow(lo, hi, total)


def test_bits():
    assert list(C.bits_of(b"\xa0\x01")) == [1, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1]
    assert list(C.joined_bits(C.ascii_bits("1 01"), [1])) == [1, 0, 1, 1]
    assert sum(C.discretise([0.5, 0.25, 0.25 - 1e-12, 1e-12], 1000)) == 1000
    assert min(C.discretise([0.999999, 1e-9, 1e-9], 16)) == 1


def test_masses_sum_to_one():
    rng = random.Random(5)
    base = M.Uniform(7)
    models = [
        M.CRP(base, Fraction(1), Fraction(1, 4)), M.PolyaTree(7, *M.even_priors(Fraction(1, 2))), M.MassPolyaTree(7, lambda a, b: b - a + 1),
        UrnPPM(base, 3, Blending(0.3, 0.4)), UrnPPM(base, 2, Blending([0.1, 0.2], [0.5, 0.6], "depth")),
        UrnPPM(base, 2, Blending([0.1, 0.2], [0.5, 0.6], "fanout")), UrnPPM(base, 2, Gradient(2, 3)), Exclusion(base, 3, 0.1, 0.5),
        SequenceMemoizer(base), SeatingCRP(base, 1.0, 0.3),
    ]
    for model in models:
        for _ in range(120):
            assert math.isclose(sum(model.mass(x) for x in range(7)), 1.0, rel_tol=1e-9), model
            model.learn(rng.choice([0, 0, 1, 2, 3, 6]))


def test_exclusion_measures_like_the_coder():
    data = b"the cat sat on the mat, the rat sat on the cat" * 4
    spec = parse("ppm:d=3:a=0:b=0.5", "uniform_byte")
    ideal = Exclusion(M.Uniform(257), 3, 0.0, 0.5)
    bits = ideal.bits(list(data)) - math.log2(ideal.mass(S.BYTE_EOF))
    assert abs(measure(data, spec) - bits) <= 3


def test_memoizer_beats_shallow_contexts_on_repeats():
    data = list(b"one two three four five six seven " * 8)
    assert SequenceMemoizer(M.Uniform(257)).bits(data) < UrnPPM(M.Uniform(257), 1, Blending(0.0, 0.5)).bits(data)


def test_special_symbols_of_ppm():
    model = M.PPM(M.Uniform(257), 2, special={"symbols": {32}, "a": Fraction(1, 2), "b": Fraction(1, 4)})
    sink = C.BitCounter()
    enc = C.Encoder(sink)
    for x in b"a b a b a b":
        model.encode(x, enc)
        model.learn(x)
    assert sink.n > 0


def test_move_to_front():
    m = M.MoveToFront(list(range(5)))
    ranks = [m.rank(x) for x in (3, 3, 0, 4, 3)]
    assert ranks == [3, 0, 1, 4, 2]
    back = M.MoveToFront(list(range(5)))
    assert [back.symbol(r) for r in ranks] == [3, 3, 0, 4, 3]


def test_specifications():
    assert str(parse("ppm:d=6", "uniform_byte")) == "ppm:d=6/uniform_byte"
    assert named("crp_polya_stoken").layers[0].get("a", "") == "1"
    with pytest.raises(ValueError):
        parse("ppm", "lzw_byte")
    with pytest.raises(ValueError):
        parse("nothing", "uniform_byte")
    with pytest.warns(UserWarning):
        assert parse_part("ppm:z=1", {"d"}).params == ()
    assert all(named(n) for n in grid_names())
    assert not [n for n in grid_names() if n.endswith("_lzw_byte") and not n.startswith("none")]
    assert set(LAYERS) == {"crp", "ppm", "lzw", "lzwEscape"}


def test_symbols_without_mass_are_refused():
    with pytest.raises(ValueError):
        measure(b"ab ab ab", parse("ppm:d=2:a=0.5:b=1", "uniform_byte"))


def test_masses_of_ppm_are_what_is_coded():
    model = M.PPM(M.Uniform(257), 2, Fraction(1, 10), Fraction(1, 2))
    for x in b"abcabdabe":
        model.learn(x)
    found = model.masses(list(range(257)))
    assert math.isclose(sum(found.values()), 1.0, rel_tol=1e-9)
    for x in (97, 98, 99, 0):
        coder = C.Encoder(C.BitCounter())
        coder.trace = []
        model.encode(x, coder)
        assert math.isclose(found[x], math.prod((b - a) / t for a, b, t in coder.trace), rel_tol=1e-9)


def test_lzma_takes_a_dictionary_of_the_size_of_the_text():
    pack, unpack = codec("ref_lzma")
    for data in (b"", b"x", bytes(range(256)) * 40):
        assert len(pack(data)) == len(lzma.compress(data, preset=9)) and unpack(pack(data)) == data
        assert lzma.LZMADecompressor(memlimit=1 << 20).decompress(pack(data)) == data


def test_traces_are_handed_on_text_by_text():
    spec = parse("ppm:d=2", "uniform_byte")
    texts = ["abab", "", None, "x" * 30, "ab"]
    parts = list(traces(iter(texts), spec, 1))
    assert [len(p) for p in parts] == [1] * 5 and all(len(p[0]) > len(t or "") for p, t in zip(parts, texts, strict=True))
    assert [t for p in parts for t in p] == [t for p in traces(texts, spec) for t in p]
