import hashlib
import math
import random

import numpy as np
import pytest

from engramix.llm import vector_codes


def brute(rows, parts, entries, rounds):
    """(vec_id, label, vector) rows to (vec_id, code, error, label_error, sha256), entry by entry."""
    kept = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = -(-len(kept[0][2]) // parts)
    kept = [(i, label, v + [0] * (parts * width - len(v))) for i, label, v in kept]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, _, v in kept[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((x - y) ** 2 for x, y in zip(cut(v, p), e, strict=True)), j) for j, e in enumerate(books[p])) for p in range(parts)] for _, _, v in kept]

    for _ in range(rounds):
        told = assign()
        for p in range(parts):
            for j in range(len(books[p])):
                own = [cut(v, p) for (_, _, v), t in zip(kept, told, strict=True) if t[p][1] == j]
                if own:
                    books[p][j] = [math.floor(sum(c) / len(own)) for c in zip(*own, strict=True)]
    told = assign()
    errors = [sum(d for d, _ in t) for t in told]
    of = {}
    for (_, label, _), e in zip(kept, errors, strict=True):
        of[label] = of.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((str(i), "".join(f"{j:02x}" for _, j in t), e, of[label], sha) for (i, label, _), t, e in zip(kept, told, errors, strict=True))


def vectors(n, size, seed=1):
    rng = random.Random(seed)
    return [[rng.choice([rng.gauss(0, 0.3), round(rng.gauss(0, 1)) / 4]) for _ in range(size)] for _ in range(n)]


@pytest.mark.parametrize(("n", "size", "entries"), [(150, 32, 64), (40, 32, 64), (90, 37, 8), (1, 16, 64)])
def test_against_brute_force(spark, n, size, entries):
    v = vectors(n, size)
    rows = [(i * 3, i % 4 if i % 7 else None, v[i]) for i in range(n)]
    rows += [(0, 1, v[0]), (0, 1, v[0]), (None, 2, v[n // 2]), (-5, None, v[0])]  # repeats, no id, a negative one
    bad = [(1000, 1, None), (1001, 1, []), (1002, 1, [math.nan] * size), (1003, 1, [math.inf] + [0.0] * (size - 1)), (1004, 1, [None] + [0.0] * (size - 1)), (1005, 1, [0.5]), (1006, 1, [1e6] * size)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + bad], "vec_id long, label int, embedding array<double>, code string, v int").repartition(3)
    got = vector_codes.compress(df, entries=entries).collect()
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == brute(rows, 16, entries, 2)


def test_empty(spark):
    none = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert vector_codes.compress(none).collect() == []
    assert vector_codes.compress(none).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_exponion_is_exact_and_skips():
    rng = np.random.default_rng(3)
    book = rng.integers(-40, 40, (64, 4)) * 50
    book[10] = book[3]  # equal entries: the lower index wins
    parts = book[rng.integers(0, 64, 5000)] + rng.integers(-9, 9, (5000, 4))
    d = ((parts[:, None] - book[None]) ** 2).sum(2)
    near = vector_codes.neighbours(book)
    best, least, compared = vector_codes.exponion(parts, book, rng.integers(0, 64, 5000), near)
    assert (best == d.argmin(1)).all() and (least == d.min(1)).all()
    again, _, compared_again = vector_codes.exponion(parts, book, best, near)
    # from the right entry hardly any other is within the radius
    assert (again == best).all() and compared_again < 0.05 * 63 * 5000 < compared


def test_decode():
    books = np.arange(2 * 3 * 2).reshape(2, 3, 2)
    assert vector_codes.decode(np.array([[0, 2], [1, 0]]), books).tolist() == [[0, 1, 10, 11], [2, 3, 6, 7]]
