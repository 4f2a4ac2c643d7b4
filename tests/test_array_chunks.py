"""Elements of JSON arrays that begin, end or go on in any chunk of a file."""

import json

import pytest

from gridscore.sources import arrays


@pytest.mark.parametrize("bits", [0, 2])
def test_elements_across_chunks(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(arrays, "CHUNK_BITS", bits)
    made = [{"a": '}{"]\\', "b": [{}, {"c": "}" * (k % 5)}]} if k % 3 else {} for k in range(30)]
    (tmp_path / "a.json").write_text(json.dumps([1, "}", *made, None], indent=bits or None))
    (tmp_path / "b.json").write_text(json.dumps(made[:1]))
    rows = arrays.read_json_array(spark, str(tmp_path)).collect()
    got = {(r.path.rsplit("/")[-1], r.pos): json.loads(r.value) for r in rows}
    assert got == {("a.json", k): x for k, x in enumerate(made)} | {("b.json", 0): made[0]} and len(rows) == 31
