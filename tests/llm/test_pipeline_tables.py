"""The stages together on empty, repeated and all-null tables."""

import pytest

from kernelspark.llm import stages
from kernelspark.llm.queries import tokenizer_path
from kernelspark.llm.tokenbin import encoder
from tests.llm.helpers import SCHEMA, rng_words


def run(spark, at, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/documents.parquet")
    return stages.run(spark, str(at)).collect()


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)] * 3, [(1, "", "en", "s", 0), (2, None, None, None, None), (3, " \n ", "en", "s", 3)]])
def test_nothing_is_kept(spark, tmp_path, rows):
    assert run(spark, tmp_path, rows) == []


def test_copies_are_kept_once(spark, tmp_path):
    text, other = (" ".join(rng_words(k, 120, 5000)) for k in (1, 2))
    rows = [(i, text, "en", "s", len(text)) for i in (7, 3, 3, 9)] + [(20, other, "en", "t", len(other)), (21, None, "en", "t", 0)]
    pieces = run(spark, tmp_path, rows)
    encode = encoder(tokenizer_path())
    size = {3: len(next(encode([text]))), 20: len(next(encode([other])))}
    assert {p.doc_id for p in pieces} <= {3, 20} and {p.doc_id for p in pieces}
    for p in pieces:
        assert p.doc_tokens == size[p.doc_id] and 0 <= p.start and p.start + p.length <= p.doc_tokens
