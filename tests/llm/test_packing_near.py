"""Near copies conflict in op 4, not only exact ones."""

from __future__ import annotations

import random
from collections import Counter

from touchline.llm import packing


def test_no_bin_holds_two_near_copies(spark, make, tmp_path):
    rng = random.Random(5)
    rows, group = [], {}
    for k in range(30):
        words = [f"w{rng.randrange(10**6)}" for _ in range(80)]
        for copy in range(3):
            changed = [*words]
            if copy:
                changed[30 * copy] = "changed"
            group[len(rows)] = k
            rows.append((len(rows), " ".join(changed), f"source {len(rows)}"))
    rows += [rows[0], (None, None, "s"), (1000, "", "t"), (1001, "", "u")]
    make("doc_id long, text string, source string", *rows).write.parquet(f"{tmp_path}/documents.parquet")
    placed = packing.op4_best_fit_packing(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in placed if r["doc_id"] is not None) == sorted(k for k, *_ in rows if k is not None)
    held = Counter((r["bin_id"], group[r["doc_id"]]) for r in placed if r["doc_id"] in group)
    assert max(held.values()) == 1
