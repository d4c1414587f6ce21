"""op6's query: counts by kind and the digest of the base spans, against the patterns as written in the contract."""

from __future__ import annotations

import hashlib
import re

from factlake.llm import queries

_ASSIGN = r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_BASE = (("assign", _ASSIGN, 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24))


def _expected(text: str | None) -> tuple[int, int, int, str]:
    spans = sorted((m.start(), i, m.end()) for i, (_, p, group, least) in enumerate(_BASE) for m in re.finditer(p, text or "") if len(m.group(group)) >= least)
    digest = ",".join(f"{_BASE[i][0]}:{a}:{b}" for a, i, b in spans)
    return (*[sum(k == i for _, k, _ in spans) for i in range(3)], hashlib.sha256(digest.encode()).hexdigest())


def test_counts_are_by_kind_wherever_a_span_stands(spark, tmp_path):
    key, access, digits = "token=abcdef1", "AKIA" + "Z9" * 9, "0123456789abcdef" * 2
    texts = [None, "", key, access, digits, f"{access} {digits} {key}", f"{key} {key} {key}", f"{digits} {digits} {access} {access}", f"😀 secret = '{digits}' {access}", "token=short SECRET: 'x' ſecret=abcdefg"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in queries.op6_secret_scan(spark, str(tmp_path)).collect()}
    assert got == {i: _expected(t) for i, t in enumerate(texts)}
