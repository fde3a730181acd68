"""What a Python worker keeps between tasks."""

from __future__ import annotations

import gc
import weakref

import pyarrow as pa

from wayfare.llm import decontaminate
from wayfare.llm.common import mapped
from wayfare.llm.tokens import encoder, word_bpe_path


def test_a_worker_keeps_one_large_table():
    one = encoder(word_bpe_path())
    one.many(["some words of a text"])
    assert encoder(word_bpe_path()) is one  # from task to task
    gone = weakref.ref(one)
    del one
    decontaminate.Templates(["A stage that has a table of its own."])
    gc.collect()
    assert gone() is None
    gone = weakref.ref(decontaminate._vocabulary())
    encoder(word_bpe_path())
    gc.collect()
    assert gone() is None


def test_a_task_gives_back_what_arrow_has_freed(spark, monkeypatch):
    released = []

    class Pool:
        def release_unused(self):
            released.append(True)

    class Table:
        sparkSession = spark

        def mapInPandas(self, function, schema):
            return function

    monkeypatch.setattr(pa, "default_memory_pool", Pool)
    task = mapped(Table(), lambda batches: (x for x in batches), "x long")
    assert list(task(iter([[1], [], [2]]))) == [[1], [2]] and released == [True]
