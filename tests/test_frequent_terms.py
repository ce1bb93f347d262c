"""Terms of long texts that cannot enter the vocabulary are not counted by document."""

import random

import pytest

from tuneshelf.operators import textindex as T
from tuneshelf.options import Settings


def corpus(spark, seed, n, words):
    rnd = random.Random(seed)
    texts = [" ".join(f"w{min(int(rnd.paretovariate(0.7)), words)}" for _ in range(rnd.randint(0, 60))) for _ in range(n)]
    rows = [(str(i % (n - 3)), t, float(i % 7)) for i, t in enumerate(texts)] + [("null", None, 0.0), ("none", "", 1.0), ("same", "w1 w1 w1 zz9 w1", None)]
    return spark.createDataFrame(rows, "doc_id string, text string, popularity double").repartition(3)


@pytest.mark.parametrize("size", [0, 1, 12, 40, 100_000])
def test_vocabulary_and_postings_of_frequent_words(spark, size):
    df, s = corpus(spark, size, 40, 200), Settings(vocab_size=size)
    plain, few = (T.build_text_index(df, settings=s, long_texts=x) for x in (False, True))
    assert sorted(map(tuple, plain.vocab.collect())) == sorted(map(tuple, few.vocab.collect()))
    rounded = [sorted((r["doc_id"], r["term"], round(r["weight"], 12), r["popularity"]) for r in i.postings.collect()) for i in (plain, few)]
    assert rounded[0] == rounded[1]


def test_rare_pairs_are_not_counted_by_document(spark):
    df = corpus(spark, 3, 60, 500)
    every, few = T.term_counts(df), T.frequent_term_counts(df, 20)
    found = few.collect()
    assert len(found) < 0.8 * every.count()
    assert set(map(tuple, found)) <= set(map(tuple, every.collect()))


def test_all_words_equally_frequent(spark):
    df = spark.createDataFrame([(str(i), f"a{i} b{i} c{i}", 0.0) for i in range(30)], "doc_id string, text string, popularity double")
    assert sorted(map(tuple, T.frequent_term_counts(df, 10).collect())) == sorted(map(tuple, T.term_counts(df).collect()))


def test_tables_on_the_way_are_removed(spark, tmp_path):
    from tuneshelf.session import ensure_checkpoint_dir
    from tuneshelf.sources import files

    def there():
        return {n.rsplit("-", 1)[0] + n[-13:] for n in files.names(spark, ensure_checkpoint_dir(spark))}

    before = there()
    index = T.build_text_index(corpus(spark, 5, 40, 200), settings=Settings(vocab_size=20), long_texts=True)
    rows = index.blocks.rows.count()
    assert rows and {n[:-13] for n in there() - before} == {"term-counts", "vocabulary", "block-rows"}
