import json

import pytest

from tessella.operators import markdown, token_cache, windows
from tessella.operators.text import word_count
from tessella.sources import readers


def test_token_cache_counts_new_texts_only(spark, tmp_path):
    path = str(tmp_path / "cache")
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, None), (4, "")], "id long, text string")
    assert token_cache.read_cache(spark, path).count() == 0
    token_cache.refresh(docs, "text", path, word_count)
    first = {(r["fingerprint"], r["tokens"]) for r in token_cache.read_cache(spark, path).collect()}
    assert sorted(n for _, n in first) == [0, 3]
    # A counter that says otherwise shows what is counted again: only the new text.
    more = docs.union(spark.createDataFrame([(5, "new one")], docs.schema))
    token_cache.refresh(more, "text", path, lambda text: word_count(text) + 100)
    rows = {r["id"]: r["tokens"] for r in token_cache.with_tokens(more, "text", path).collect()}
    assert rows == {1: 3, 2: 3, 3: 0, 4: 0, 5: 102}


def test_discover_and_inventory(spark, tmp_path):
    for name in ("b/x_refined.txt", "b/x_mini_refined.txt", "c/y_refined.txt", "c/z.csv", "_hidden/w_refined.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("12345")
    found = readers.discover(spark, str(tmp_path), "*_refined.txt", ("_refined$", ""), "_mini")
    assert sorted((r["stem"], r["variant"], r["length"]) for r in found.collect()) == [("x", "", 5), ("x", "_mini", 5), ("y", "", 5)]
    assert {r["variant"]: (r["n_files"], r["bytes"]) for r in readers.inventory(found, [found["variant"]]).collect()} == {"": (2, 10), "_mini": (1, 5)}


def test_line_and_array_sinks(spark, tmp_path):
    frame = spark.createDataFrame([(i, f"line {i} \t é ") for i in range(50)], "i long, line string").repartition(6)
    readers.write_lines(frame.where("i % 3 = 0"), "line", ["i"], str(tmp_path / "lines"))
    parts = sorted((tmp_path / "lines").glob("part-*"))
    assert "".join(p.read_text() for p in parts) == "".join(f"line {i} \t é \n" for i in range(0, 50, 3))
    for n in (50, 1, 0):
        path = tmp_path / f"array{n}"
        readers.write_json_array(frame.where(f"i < {n}"), ["i"], str(path))
        text = "".join(p.read_text() for p in sorted(path.glob("part-*")))
        assert [r["i"] for r in json.loads(text)] == list(range(n))


MD = """

# Title

Intro words here.

## Small
one two three

## Large
### Fits
four five six
### Long
aa bb cc dd ee

ff gg

```py x
l1 l2 l3 l4
# no heading

m1 m2 m3 m4 m5 m6 m7 m8 m9
```
tail
"""


def test_markdown_chunks(spark):
    frame = spark.createDataFrame([(1, MD), (2, None), (3, " \n\n"), (4, "```\nopen a b"), (5, "w " * 25)], "id long, md string")
    chunks = {}
    for r in markdown.markdown_chunks(frame, "id", "md", 10).orderBy("chunk_id").collect():
        chunks.setdefault(r["id"], []).append((r["num_tokens"], r["chunk"]))
        assert r["num_tokens"] <= 10
    assert 2 not in chunks and 3 not in chunks
    assert [c for _, c in chunks[1]] == [
        "# Title\n\nIntro words here.",
        "## Small\none two three",
        "## Large",
        "### Fits\nfour five six",
        "### Long\naa bb cc dd ee\n\nff gg",
        "```py x\nl1 l2 l3 l4\n# no heading\n\n```",
        "```py x\nm1 m2 m3 m4 m5 m6 m7\n```",
        "```py x\nm8 m9\n```",
        "tail",
    ]
    assert [n for n, _ in chunks[5]] == [10, 10, 5] and chunks[4] == [(4, "```\nopen a b")]


@pytest.mark.parametrize("times", [[0, 10, 25, 40], [0, 0, 0, 0]])
def test_refined_times_follow_each_other(spark, times):
    ranges = spark.createDataFrame([("k", 1, 0, 1, 5), ("k", 2, None, None, 7), ("k", 3, 2, 3, 1), ("k", 4, None, None, 2)], "k string, i long, first_group long, last_group long, d long")
    groups = spark.createDataFrame([("k", i, t) for i, t in enumerate(times)], "k string, g long, at long")
    got = [(r["start"], r["end"]) for r in windows.refined_times(ranges, groups, ["k"], "i", "d", "g", "at").orderBy("i").collect()]
    end, wanted, nominal = 0, [], 0
    for (_, _, a, z, d) in [tuple(r) for r in ranges.orderBy("i").collect()]:
        nominal += d
        steps = sorted(t - s for s, t in zip(times[a:z], times[a + 1 : z + 1]) if t > s) if a is not None else []
        own = nominal if a is None else times[z] + (steps[len(steps) // 2] if steps else d)
        wanted.append((end, max(end + d, own)))
        end = wanted[-1][1]
    assert got == wanted
