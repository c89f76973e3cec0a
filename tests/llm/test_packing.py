import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidyledger.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("capacity", [7, 10, 64, 4096])
def test_plans_are_gapless_and_close_to_the_bound(capacity):
    r = random.Random(capacity)
    for _ in range(60 if capacity < 4096 else 3):
        lengths = [min(capacity, max(1, int(r.lognormvariate(0, 1.2) * capacity / 5))) for _ in range(r.randint(0, 400))]
        rows, n = packing.plan(dict(Counter(lengths)), capacity)
        places, ranks = defaultdict(list), set()
        for length, rank, pieces, first, offset, per in rows.tolist():
            for j in range(pieces):
                places[first + j // per].append((offset + length * (j % per), length))
                ranks.add((length, rank + j))
        assert ranks == {(n_, i) for n_, c in Counter(lengths).items() for i in range(c)}
        assert set(places) == set(range(n))
        for items in places.values():
            end = 0
            for offset, length in sorted(items):
                assert offset == end
                end += length
            assert end <= capacity
        least = max(-(-sum(lengths) // capacity), sum(2 * x > capacity for x in lengths))
        assert n <= 1.25 * least + 1


def test_word_ids_equal_the_tokenizer():
    texts = ["", " ", "Hello, World!! it's don't 'quoted' 12ab", "É é é Ǆ ﬁ İstanbul ßẞ Σας", "a<|endoftext|>b <|ENDOFTEXT|> x",
             "x y\x1cz\x85w 　 中文字 テスト", "word.,;:!?*#%&$| end|> a|b <|", "tabs\tand\x0bfeeds\x0c", "🙂🙂 ok…", "UPPER lower MiXed."]
    tokenizer = Tokenizer.from_file(PATH)
    got = packing.WordIds(PATH).ids(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_pieces_come_back_as_the_documents(docs_of, odd_rows):
    docs = docs_of(odd_rows)
    tokenizer = Tokenizer.from_file(PATH)
    want = Counter((d, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])) for d, t in odd_rows)
    got = packing.pack(docs, PATH, capacity=512).collect()
    longest = max(len(ids) for _, ids in want)
    assert longest > 5 * 512
    cut = Counter()
    for (d, ids), n in want.items():
        for piece, start in enumerate(range(0, len(ids), 512)):
            some = ids[start:start + 512]
            cut[(d, piece, start, len(some), zlib.crc32(np.array(some, "<u4").tobytes()))] += n
    assert Counter((g.doc_id, g.piece, g.start, g.length, g.ids_crc32) for g in got) == cut
    by_sequence = defaultdict(list)
    for g in got:
        by_sequence[g.sequence_id].append((g.offset, g.length))
    for items in by_sequence.values():
        assert [o for o, _ in sorted(items)] == [sum(n for _, n in sorted(items)[:i]) for i in range(len(items))]
        assert sum(n for _, n in items) <= 512
    whole = packing.sequences(docs, PATH, capacity=512).collect()
    ids = Counter(i for s in whole for i in s.ids)
    assert ids == sum((Counter({i: c * n for i, c in Counter(t).items()}) for (_, t), n in want.items()), Counter())
    assert len(whole) == len(by_sequence)


def test_no_documents(docs_of):
    assert packing.pack(docs_of([]), PATH).count() == 0


def test_word_tables_hold_no_words_that_came_once_and_stay_bounded(monkeypatch):
    words = packing.WordIds(PATH)
    once = " ".join(f"word{i}x" for i in range(2000))
    plain = list(words.ids([once]))
    assert len(words.words) < 20 and len(words.parts) < 20  # a few marks may meet by chance
    assert list(words.ids([once])) == plain and len(words.words) > 1900
    monkeypatch.setattr(packing, "CACHED_WORDS", 100)
    small = packing.WordIds(PATH)
    assert [list(small.ids([once])) for _ in range(3)] == [plain] * 3
    assert len(small.words) <= 100 and len(small.parts) <= 100
