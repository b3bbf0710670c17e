import random

import numpy as np
import pyarrow as pa
from test_line_dedup import edit

from lodeworks.llm.line_dedup import bucket_entries, bucket_reader, proposals, within


def tile(sizes, marks, components, sides=None, apart=False):
    n = len(sizes)
    return pa.table(
        {"id": pa.array(range(n), pa.int64()), "size": pa.array(sizes, pa.int64()), "sketch": pa.array(marks, pa.int64()),
         "c": pa.array(components, pa.int64()), "side": pa.array(sides or [0] * n, pa.int32()), "apart": [apart] * n}
    )


def test_edit_limit_equals_the_distance():
    rng = random.Random(6)
    for _ in range(600):
        a = "".join(rng.choices("abé語 ", k=rng.randrange(1, 90)))
        b = list(a)
        for _ in range(rng.randrange(9)):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randrange(2)] = rng.choices("abé", k=rng.randrange(2))
        b = "".join(b)
        assert [within(a, b, k) for k in range(12)] == [edit(a, b) <= k for k in range(12)]


def test_alike_lines_of_a_large_bucket_give_no_square_of_pairs():
    found = proposals(1)(tile([100] * 400, [0] * 400, range(400)))
    assert found.num_rows == 399 and found.column("more").to_pylist() == [False] + [True] * 398


def test_proposals_leave_out_what_is_settled_and_keep_the_rest():
    marks = [0, 0, -1, 0, 1]
    sizes = [100, 100, 100, 80, 100]
    found = proposals(8)(tile(sizes, marks, [0, 0, 2, 3, 4])).to_pylist()
    assert [(r["a"], r["b"]) for r in found] == [(0, 4), (1, 4)] and not any(r["more"] for r in found)
    found = proposals(8)(tile(sizes, marks, [0, 0, 2, 3, 4], [0, 1, 0, 0, 1], True)).to_pylist()
    assert [(r["a"], r["b"]) for r in found] == [(0, 4)]


def test_places_travel_with_the_entries():
    batch = pa.RecordBatch.from_arrays([pa.array(["one line\n!\none LINE", None, "other"]), pa.array([7, 8, 9])], ["text", "doc_id"])
    rows = pa.Table.from_batches(bucket_reader(128)(bucket_entries(1, False, True)([batch]))).to_pylist()
    places = [(r["a"], r["line"]) for r in rows if r["line"] is not None]
    assert sorted(places) == [(7, 0), (7, 2), (9, 0)] and len({r["b"] for r in rows}) == 2
    assert all(np.array([r["bucket"] is None for r in rows]))
