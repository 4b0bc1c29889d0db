import re
import time

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from scoreweave.llm import shared as S
from scoreweave.session import CLEANUP, forget, settle

TEXT = st.text(alphabet="ab AB.\t\n\x0b\x0c\r\x1c\x1f\u00a0é日", max_size=40)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8))
def test_words_are_runs_without_the_six_blanks(texts):
    words = S.Words(pa.array(texts, pa.string()))
    vocab = words.vocab.to_pylist()
    got = [[vocab[i].decode() for i in words.ids[a:b]] for a, b in zip(words.offsets[:-1], words.offsets[1:], strict=True)]
    assert got == [re.findall(S.WORD, t or "") for t in texts]


def test_words_of_a_slice_and_lower_case():
    texts = pa.array(["zzz", "Ab CÉ", None, "ab"], pa.string()).slice(1, 3)
    words = S.Words(texts, lower=True)
    assert [words.vocab[i].as_py().decode() for i in words.ids] == ["ab", "cÉ", "ab"]
    assert words.counts.tolist() == [2, 0, 1]


def test_rolling_hashes_tell_ranges():
    values = np.array([5, 9, 5, 9, 5, 9, 7], np.uint64)
    rolling = S.Rolling(values)
    found = rolling.at(np.array([0, 2, 4, 1]), 2)
    assert found[0] == found[1] == found[2] != found[3]
    assert rolling.at(np.array([0]), 2)[0] != rolling.at(np.array([0]), 3)[0]


def test_sliding():
    x = np.array([4, 2, 7, 1, 9, 3], np.uint64)
    for width in range(1, 7):
        assert S.sliding(x, width, np.minimum).tolist() == [min(x[i : i + width].tolist()) for i in range(len(x) - width + 1)]
    assert not len(S.sliding(x, 7, np.minimum))


def test_steps_keep_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 5000, "c"] * 5)], ["text"])
    assert sum((p.column(0).to_pylist() for p in S.steps(iter([batch]), limit=100)), []) == batch.column(0).to_pylist()


def test_bitmap_misses_none(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    inside, outside = S.part_by(df, df.where("k % 7 = 0"), "k")
    found = {r.k for r in inside.collect()}
    assert {k for k in range(2000) if k % 7 == 0} <= found and len(found) < 400
    assert {r.k for r in outside.collect()} == set(range(2000)) - found


def test_shuffle_files_go_with_a_tidy_write(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    # A sequence's text: names of files, whatever their folders.
    files = lambda: {x for x in re.findall(r"shuffle_\d+_\d+_\d+\.data", blocks.getAllFiles().mkString(" "))}
    before, how = files(), spark.conf.get(CLEANUP)
    rows = spark.range(1000).repartition(3, "id")
    table = settle(rows, "loose")
    loose = files() - before
    forget(table)
    assert loose  # else this test sees nothing
    before |= loose
    table = settle(rows, "tidy", tidy=True)
    end = time.monotonic() + 10
    while files() - before and time.monotonic() < end:
        time.sleep(0.1)
    assert not files() - before and spark.conf.get(CLEANUP) == how
    assert table.count() == 1000
    forget(table)
