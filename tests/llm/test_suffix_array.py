import numpy as np
from hypothesis import given, settings, strategies as st

from sievelake.llm import suffix_array as sa


def naive(text):
    return sorted(range(len(text)), key=lambda i: text[i:])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=120))
def test_small_alphabet(text):
    assert sa.suffix_array(np.array(text)).tolist() == naive(text)


def test_longer_texts():
    rng = np.random.default_rng(1)
    for size, top in ((3000, 2), (3000, 256), (2000, 1), (4000, 30)):
        text = rng.integers(0, top, size).tolist()
        text[1000:1400] = text[200:600]
        assert sa.suffix_array(np.array(text)).tolist() == naive(text)
    text = list(range(100)) * 20
    assert sa.suffix_array(np.array(text)).tolist() == naive(text)
    assert sa.suffix_array(np.array(text[::-1])).tolist() == naive(text[::-1])


def test_common_prefixes():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 3, 2000).astype(np.uint8)
    data[700:800] = data[100:200]
    order = sa.suffix_array(data.astype(np.int64))
    got = sa.permuted_prefix_at_least(data, order, 50)
    raw = data.tobytes()
    for k, i in enumerate(order):
        j = order[k - 1]
        want = k > 0 and min(i, j) >= 0 and len(raw[i : i + 50]) == 50 and raw[i : i + 50] == raw[j : j + 50]
        assert got[i] == want


def test_order_to_a_depth():
    rng = np.random.default_rng(3)
    for size, top, depth in ((4000, 2, 5), (4000, 256, 3), (6000, 30, 50)):
        text = rng.integers(0, top, size)
        text[1000:1900] = text[2000:2900] = text[100:1000]
        order = sa.suffix_array(text, depth).tolist()
        assert sorted(order) == list(range(size))
        heads = [text[i : i + depth].tolist() for i in order]
        assert heads == sorted(heads)


def test_only_tied_suffixes_are_sorted_again(monkeypatch):
    names = np.random.default_rng(4).permutation(5000)
    names[4000:4010] = names[100:110]
    sizes, plain = [], np.sort
    monkeypatch.setattr(np, "sort", lambda a, *rest, **more: sizes.append(len(a)) or plain(a, *rest, **more))
    assert sa._doubling(names).tolist() == naive(names.tolist())
    assert sizes[0] == 5000 and sum(sizes[1:]) < 200
