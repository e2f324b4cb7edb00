"""Python steps over texts hold a bounded piece of a batch as Python strings."""

import pyarrow as pa

from gazette.functions import text


def test_a_batch_of_long_texts_is_taken_in_pieces():
    values = [None if i % 7 == 3 else ("a" * 5000 + str(i)) for i in range(2000)] + ["b" * 3_000_000, ""]
    seen = []

    def work(own):
        seen.append(sum(len(x or "") for x in own))
        return pa.array(own, pa.string())

    for batch in (pa.array(values), pa.array(["x", *values]).slice(1), pa.array([], pa.string()), pa.array([None], pa.string())):
        seen.clear()
        assert text.in_pieces(batch, work).to_pylist() == batch.to_pylist()
        assert max(seen) <= 3 * text.PIECE + 3_000_000 and (len(batch) < 100 or len(seen) > 5)
