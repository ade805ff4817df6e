import numpy as np
import pytest

from graphloom.llm import byteranges, tokencount
from graphloom.llm.storage import new_dir
from graphloom.llm.tokens import vocabulary_paths


@pytest.mark.parametrize(("name", "block"), [("odd_docs", 5), ("odd_docs", 1 << 20), ("no_docs", 100), ("docs", 777)])
def test_counts(request, spark, name, block):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_paths()[0])
    tokenizer.encode_special_tokens = True
    df = request.getfixturevalue(name)
    want = sorted((str(r.doc_id), len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)) for r in df.collect())
    got = tokencount.count_tokens(df, new_dir(spark, "flat"), block_tokens=block).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == want


@pytest.mark.parametrize("block", [1, 2, 3, 7, 100])
def test_stitching_over_blocks(spark, tmp_path, block):
    lengths = [0, 5, 0, 0, 23, 1, 9]
    ids = [x for n in lengths for x in [*range(1, n + 1), tokencount.SEPARATOR]] + [4, 4]
    path = tmp_path / "x.tokens"
    path.write_bytes(np.array(ids, "<u2").tobytes())
    blocks = tokencount.file_blocks(spark.createDataFrame([(str(path),)], "file string"), block)
    got = tokencount.stitch(tokencount.scan_blocks(blocks)).orderBy("ordinal").collect()
    assert [(r.ordinal, r.n_tokens) for r in got] == list(enumerate(lengths))


def test_paths_without_a_scheme_get_the_default_file_system(spark, tmp_path):
    name = byteranges.qualified(spark, str(tmp_path / "a" / "b c.tokens"))
    assert name.startswith("file:/")
    with byteranges.created(name) as file:
        file.write(b"xyz")
    with byteranges.opened(name) as file:
        assert file.read() == b"xyz"
