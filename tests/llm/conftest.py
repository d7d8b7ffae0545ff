import sys
from pathlib import Path

import public_tokenizers
import pytest
import tiktoken

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from codelens_spark.llm.bpe import read_ranks  # noqa: E402


@pytest.fixture(scope="module")
def tik():
    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture
def documents(spark):
    """documents(rows): a table like documents, with a column more and clashing names."""

    def make(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, text_ string, size long, component long"
        return spark.createDataFrame([(*r, *(None,) * (8 - len(r))) for r in rows], schema)

    return make
