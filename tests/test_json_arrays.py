"""The reader of huge JSON arrays by ranges of bytes, against the whole-document parser."""

import json
import random

import pytest

from fieldtrace.sources import json_arrays as J


def inside(value, key):
    """The objects right inside the arrays of that name; such an array isn't looked into."""
    if isinstance(value, dict):
        for k, v in value.items():
            if k == key and isinstance(v, list):
                yield from (x for x in v if isinstance(x, dict))
            else:
                yield from inside(v, key)
    elif isinstance(value, list):
        for v in value:
            yield from inside(v, key)


def made(rng, depth=0):
    text = lambda: "".join(rng.choice(['a', 'é', '"', "\\", "{", "}", "[", "]", "\n", '"items": [', "🙂"]) for _ in range(rng.randrange(6)))
    kind = rng.random()
    if depth > 4 or kind < 0.25:
        return rng.choice([text(), 7, -1.5, None, True, []])
    if kind < 0.5:
        return [made(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["items", "x", text()]) if rng.random() < 0.6 else "items": [made(rng, depth + 1) for _ in range(rng.randrange(4))] if rng.random() < 0.5 else made(rng, depth + 1) for _ in range(rng.randrange(4))}


@pytest.mark.parametrize("seed", range(60))
def test_ranges_against_whole_documents(tmp_path, monkeypatch, seed):
    rng = random.Random(seed)
    value = {"a": made(rng), "items": [made(rng) for _ in range(rng.randrange(5))], "b": made(rng)}
    raw = json.dumps(value, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
    path = tmp_path / "a.json"
    path.write_text(raw)
    monkeypatch.setattr(J, "BLOCK_BYTES", rng.choice([1, 3, 16, 1 << 20]))
    size, step = path.stat().st_size, rng.choice([1, 5, 17, 64, 10_000])
    state, found = (False, 0, -1), []
    for start in range(0, size, step):
        stop = min(start + step, size)
        both = [J.summary(f"file://{path}", start, stop, "items", t) for t in (False, True)]
        found += [json.loads(t) for t in J.texts_of(f"file://{path}", start, stop, size, "items", state)]
        state = J.following(state, both[int(state[0])])
    assert found == list(inside(value, "items"))
    assert state == (False, 0, -1)


def test_elements_as_rows(spark, tmp_path):
    """Two orders of keys, an array of the same name inside an element, texts that look like arrays, garbage between elements, and an end that is broken off."""
    rows = [{"latitudeE7": k, "longitudeE7": -k, "note": '"locations": [{"latitudeE7": 0}]', "locations": [{"latitudeE7": -1}]} for k in range(3000)]
    turned = [dict(reversed(list(r.items()))) if k % 2 else r for k, r in enumerate(rows)]
    (tmp_path / "a.json").write_text('{"settings": {"locations": "none [{"}, "locations": [\n' + ", \n garbage ".join(json.dumps(r, indent=2 if k % 3 else None) for k, r in enumerate(turned)) + '\n], "more": {"latitudeE7": 1}}')
    (tmp_path / "b.json").write_text('{"locations": []}')
    (tmp_path / "c.json").write_text('[{"locations" : [{"latitudeE7": 9000, "longitudeE7": -9000}, {"latitudeE7": 9001, "longit')
    (tmp_path / "d.json").write_text("")
    got = J.elements(spark, str(tmp_path / "*.json"), "locations", "latitudeE7 long, longitudeE7 long, note string", range_bytes=20_000).collect()
    assert sorted((r.latitudeE7, r.longitudeE7) for r in got) == [(k, -k) for k in range(3000)] + [(9000, -9000)]
    assert {r.note for r in got} == {rows[0]["note"], None}
