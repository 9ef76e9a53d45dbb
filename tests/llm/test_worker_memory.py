"""What a Python worker keeps between tasks."""

import weakref

import public_tokenizers
import pyarrow as pa

from topicflow.llm.common import per_worker, slices
from topicflow.llm.packing import WordEncoder


class Cache:
    pass


def test_a_cache_outlives_tasks_of_its_key_only():
    rows = pa.RecordBatch.from_pydict({"x": list(range(5))})
    kept = weakref.ref(per_worker(("words",), Cache))
    assert [b.num_rows for b in slices(iter([rows]), 3, key=("words",))] == [3, 2]
    assert kept() is per_worker(("words",), Cache)
    assert [b.num_rows for b in slices(iter([rows]), 3)] == [3, 2]  # another operator's task
    assert kept() is None


def test_a_small_cache_gives_the_same_ids():
    path = public_tokenizers.path("word_bpe_49k.json")
    few, many = WordEncoder(path, 3), WordEncoder(path)
    for texts in (["A bold idea, said o'Neil.", ""], ["idea bold\nzyxwv zyxwv", "café <|x|> 12.5"], ["A bold idea, said o'Neil."]):
        assert few(texts) == many(texts)
