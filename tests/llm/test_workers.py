"""Workers that can't import this package: only the driver has it on its path."""

import os
import subprocess
import sys

import public_tokenizers
import pyarrow as pa
import pytest

from rolecall.llm import jaccard, langid, packing, tokens, worker
from rolecall.llm.tokens import VOCABULARY, WordEncoder
from rolecall.session import ARROW_ROWS

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

RUN = """
import sys
sys.path.insert(0, sys.argv[1])
from rolecall.llm import queries
from rolecall.session import build_session
spark = build_session("elsewhere", "local[2]", {"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2",
                                                "spark.checkpoint.dir": sys.argv[4]})
print("rows", len(queries.QUERIES[sys.argv[2]](spark, sys.argv[3]).collect()))
"""


@pytest.mark.parametrize("name", ["op10_licences", "op11_spelling", "op12_simhash", "op13_merkle"])
def test_queries_run_elsewhere(name, sf_dir, tmp_path):
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", RUN, ROOT, name, sf_dir, str(tmp_path / "scratch")], cwd=tmp_path,
                          env=environment, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "rows" in done.stdout


def test_workers_hand_back_what_arrow_freed(monkeypatch):
    """After each batch and at the end, also where a task stops early; the rows stay."""
    class Pool:
        released = 0

        def release_unused(self):
            self.released += 1

    pool = Pool()
    monkeypatch.setattr(pa, "default_memory_pool", lambda: pool)
    batches = [pa.record_batch([pa.array([i, i + 1])], names=["x"]) for i in range(3)]
    run = worker.lean(lambda given: (b for b in given))
    assert list(run(iter(batches))) == batches and pool.released == 4
    stopped = run(iter(batches))
    next(stopped)
    stopped.close()
    assert pool.released == 5


def test_texts_are_shingled_and_packed_by_lean_workers(spark, documents, monkeypatch):
    made = []
    monkeypatch.setattr(jaccard, "lean", lambda run: made.append(run) or run)
    monkeypatch.setattr(langid, "lean", lambda run: made.append(run) or run)
    monkeypatch.setattr(packing, "lean", lambda run: made.append(run) or run)
    docs = documents([(1, "one two three four five six"), (2, None)])
    langid.identify(docs, {"en": b"one two"})
    packing.pack(docs, public_tokenizers.path(VOCABULARY), end_id=0)
    assert len(made) == 2
    jaccard.jaccard_join(docs)
    assert len(made) > 4


def test_words_are_learned_some_at_a_time(monkeypatch):
    """The library never gets more than a few words at once, and the ids are the same."""
    words = pa.array([" ".join(f"word{i}x{k}" for i in range(50)) for k in range(5)])
    whole = WordEncoder(public_tokenizers.path(VOCABULARY))
    expected = [(first, ids.tolist(), offsets.tolist()) for first, ids, offsets in whole.encode(words)]
    given = []
    some = WordEncoder(public_tokenizers.path(VOCABULARY))

    class Counted:
        def encode_batch_fast(self, batch, **kw):
            given.append(len(batch))
            return whole.tokenizer.encode_batch_fast(batch, **kw)

    some.tokenizer = Counted()
    monkeypatch.setattr(tokens, "LEARNED", 7)
    got = [(first, ids.tolist(), offsets.tolist()) for first, ids, offsets in some.encode(words)]
    assert got == expected and max(given) == 7 and sum(given) == whole.used - 1


def test_a_stage_frees_what_earlier_ones_kept(monkeypatch):
    store = {("encoder", "a"): 1, ("languages",): 2}
    monkeypatch.setattr(worker, "_store", lambda: store)
    batches = [pa.record_batch([pa.array([1])], names=["x"])]
    assert list(worker.only(lambda given: given, ("encoder", "a"))(iter(batches))) == batches
    assert store == {("encoder", "a"): 1}
    list(worker.only(lambda given: given)(iter(batches)))
    assert store == {}


def test_texts_are_handed_to_python_some_at_a_time(spark, documents, monkeypatch):
    """While shingles are made, an Arrow batch has few rows; the session is left as it was."""
    before, during = spark.conf.get(ARROW_ROWS), []
    write = jaccard.materialize
    monkeypatch.setattr(jaccard, "ROWS", 2)
    monkeypatch.setattr(jaccard, "materialize", lambda df, label: during.append(spark.conf.get(ARROW_ROWS)) or write(df, label))
    found = jaccard.jaccard_join(documents([(k, "one two three four five six") for k in range(5)])).documents()
    assert {(r.doc_id, r.component_id) for r in found.collect()} == {(k, 0) for k in range(5)}
    assert set(during) == {"2"} and spark.conf.get(ARROW_ROWS) == before


def test_shingles_are_counted_over_batches():
    """A shingle that is in one text of each batch repeats all the same."""
    batches = [pa.record_batch([pa.array([k]), pa.array([f"a b {k}"])], names=["doc_id", "text"]) for k in range(3)]
    rows = [r for b in jaccard._describe(2)(iter(batches)) for r in b.to_pylist()]
    assert [r["times"] for r in rows if r["shingle"] is not None] == [3]
    assert [r["doc_id"] for r in rows if r["sig"] is not None] == [0, 1, 2]
