"""The index of earlier batches against one run over everything, with batches repeated after compactions."""

from __future__ import annotations

import pytest

from tessera.llm import substring


def test_batches_are_one_run(spark, tmp_path):
    common = [" ".join(f"c{k}w{i}" for i in range(15)) for k in range(6)]
    rows = [(10 * b + j, f"own{b}x{j} {common[(b + j) % 6]} {common[max(b - 2, 0)]}") for b in range(6) for j in range(2)]
    table = lambda r: spark.createDataFrame(r, "doc_id long, text string")
    plain = lambda df: {r["doc_id"]: (r["n_removed"], r["kept"]) for r in df.collect()}
    want = plain(substring.dedup(table(rows)))
    assert sum(n for n, _ in want.values()) > 0
    index, late = str(tmp_path / "index"), []
    run = lambda b: substring.dedup(table([r for r in rows if r[0] // 10 == b]), index=index, batch=b)
    of = lambda b: {i: v for i, v in want.items() if i // 10 == b}
    for b in range(6):
        late.append(run(b))
        if b == 3:  # just compacted
            assert plain(run(3)) == of(3)
            assert plain(run(2)) == of(2)
    assert [plain(df) for df in late] == [of(b) for b in range(6)]  # read only now
    run(6), run(7)
    with pytest.raises(ValueError):
        run(2)
