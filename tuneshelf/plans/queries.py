"""Registered queries: each takes (spark, sf_dir) and returns a lazy DataFrame.

Every column is aliased to the name used by the matching SQL in ``oracle.py``.
Scores are reported rounded half-up (4 decimals, 10 for the rank key), floats
that pass through log/sqrt at 10 decimals.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import rules as R
from ..functions.vectors import cosine
from ..operators import documents as D
from ..operators import embed as E
from ..operators import grounding as G
from ..operators import lsa as LS
from ..operators import mentions as M
from ..operators import pq as PQ
from ..operators import profiles as P
from ..operators import retrieve as RT
from ..operators import semantic as SM
from ..operators import textindex as T
from ..operators.sizing import broadcast_if_small
from ..options import DEFAULT, Settings
from ..session import cut_lineage, scratch_path
from ..sources import csvscan as C
from ..sources import tables as S
from . import catalog_jobs as J
from . import increment as I
from . import pipeline as PL
from . import store as ST

Query = Callable[[SparkSession, str], DataFrame]
K = DEFAULT.top_k


def _score4(c: str = "score"):
    return R.round_half_up(c, 4).alias(c)


# --------------------------------------------------------------- sources ---

def scan_catalog(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "catalog-csv")
    C.write_catalog_csv(S.catalogue(spark, sf), path)
    df = C.read_catalog_csv(spark, path)
    return df.select("ordinal", "track_id", "track_name", "track_artist", "track_album_name",
                     "track_album_release_date", "playlist_genre", "playlist_subgenre",
                     "track_popularity", "energy", "danceability", "valence", "tempo")


def scan_songs_strict(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "songs-csv")
    C.write_songs_csv(P.songs_from_catalog(J.Catalog(spark, sf).unique), path)
    return C.read_songs_strict(spark, path)


def index_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Build-if-absent twice (the second call must find the artefacts), then reopen."""
    root = scratch_path(spark, "index")
    if not ST.ensure_built(spark, sf, root) or ST.ensure_built(spark, sf, root):
        raise RuntimeError("build-if-absent did not build exactly once")
    idx = ST.open_index(spark, root)
    return idx.vocab.select("term", "df", "cf", R.round_half_up("idf", 10).alias("idf"))


def _changed_catalogue(spark: SparkSession, sf: str) -> str:
    """A live catalogue that reaches the present one by three change sets: a tenth of the items
    is added, a tenth corrected (name, genre and artist), and some that never were are changed
    and removed."""
    root = scratch_path(spark, "live-catalogue")
    rows = J.Catalog(spark, sf).unique
    part = F.col("ordinal") % 10
    ghosts = rows.filter(part == 3).withColumns({
        "ordinal": F.col("ordinal") + 5_000_000_000, "track_id": F.concat(F.lit("ghost-"), "track_id"),
        "track_artist": F.when(F.col("ordinal") % 20 == 3, F.lit("Ghost")).otherwise(F.col("track_artist"))})
    draft = rows.filter(part == 2).withColumns({
        "track_name": F.concat("track_name", F.lit(" draft")), "playlist_genre": F.lit("draft"),
        "track_artist": F.when(F.col("ordinal") % 20 == 2, F.lit("Draft")).otherwise(F.col("track_artist"))})
    first = rows.filter(~part.isin(1, 2)).unionByName(draft).unionByName(ghosts)
    renamed = ghosts.filter(F.col("ordinal") % 20 == 3).withColumn("track_name", F.concat(F.lit("the "), "track_name"))
    for change in (first, rows.filter(part == 1), rows.filter(part == 2).unionByName(renamed)):
        I.apply_changes(spark, root, change.withColumn("deleted", F.lit(False)))
    I.apply_changes(spark, root, ghosts.withColumn("deleted", F.lit(True)))
    return root


def incremental_vocab(spark: SparkSession, sf: str) -> DataFrame:
    """Corpus statistics after three change sets: those of a full rebuild."""
    vocab = I.live_index(spark, _changed_catalogue(spark, sf)).vocab
    return vocab.select("term", "df", "cf", R.round_half_up("idf", 10).alias("idf"))


def incremental_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Artists after three change sets: those of a full rebuild."""
    return I.live_rollup(spark, _changed_catalogue(spark, sf))


def index_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Two ingests and one that dies half-way: the second stays current and whole, the
    first can still be opened."""
    root = scratch_path(spark, "index-snapshots")
    small = Settings(vocab_size=200)
    first, second = ST.ingest(spark, sf, root, small), ST.ingest(spark, sf, root)
    J.Catalog(spark, sf, small).index.vocab.write.parquet(f"{root}/versions/died/vocab")  # no manifest names it
    each = [ST.snapshot(spark, root, n) for n in (first, second)]
    if ST.snapshot(spark, root).number != second:
        raise RuntimeError("an unpublished ingest became current")
    rows = [s.read(spark, p).agg(F.lit(s.number).alias("snapshot"), F.lit(p).alias("part"), F.count(F.lit(1)).alias("n_rows"))
            for s in each for p in ("docs", "vocab", "postings", "popularity")]
    return functools.reduce(DataFrame.unionByName, rows)


# ----------------------------------------------------------- projections ---

def safe_numeric(spark: SparkSession, sf: str) -> DataFrame:
    cat = S.catalogue(spark, sf)
    # parse the text form too: the rule must give the same value from text and number
    return cat.select("track_id", *[R.safe(F.col(c).cast("string")).alias(c) for c in
                                    ["track_popularity", "energy", "danceability", "valence", "tempo"]])


def threshold_buckets(spark: SparkSession, sf: str) -> DataFrame:
    cat = S.catalogue(spark, sf)
    return cat.select("track_id", R.energy_bucket("energy").alias("energy_desc"),
                      R.track_mood("valence").alias("mood"))


def track_blurb(spark: SparkSession, sf: str) -> DataFrame:
    return J.Catalog(spark, sf).tracks.select("doc_id", "blurb")


def track_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return J.Catalog(spark, sf).tracks.select(
        "doc_id", "doc_type", "track_name", "track_artist", "track_album_name", "playlist_genre",
        "playlist_subgenre", "track_popularity", "energy", "danceability", "valence", "tempo")


# ---------------------------------------------------------- aggregations ---

def dedup_keep_first(spark: SparkSession, sf: str) -> DataFrame:
    li = S.table(spark, sf, "lineitem")
    keys = ["l_orderkey", "l_linenumber"]
    order = [c for c in li.columns if c not in keys]
    out = D.keep_first(li, keys, order)
    return out.select(*[(F.col(c) + F.lit(0.0)).alias(c) if t == "double" else F.col(c)
                        for c, t in out.dtypes])


def artist_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return J.Catalog(spark, sf).rollup


def artist_blurb(spark: SparkSession, sf: str) -> DataFrame:
    return D.artist_documents(J.Catalog(spark, sf).rollup).select("doc_id", "blurb")


def all_documents(spark: SparkSession, sf: str) -> DataFrame:
    return J.Catalog(spark, sf).docs.select("doc_id", "doc_type", "blurb", "artist")


def ingest_stats(spark: SparkSession, sf: str) -> DataFrame:
    return PL.ingest_stats(spark, sf)


# ------------------------------------------------------------ text index ---

def tokenize(spark: SparkSession, sf: str) -> DataFrame:
    return T.document_token_stats(S.text_corpus(spark, sf))


def tfidf_vocab(spark: SparkSession, sf: str) -> DataFrame:
    v = J.document_index(spark, sf).vocab
    return v.select("term", "df", "cf", R.round_half_up("idf", 10).alias("idf"))


def tfidf_postings(spark: SparkSession, sf: str) -> DataFrame:
    p = J.document_index(spark, sf).postings
    return p.select("doc_id", "term", R.round_half_up("weight", 10).alias("weight"))


def tfidf_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The fixed sample questions, and the questions that name items."""
    sample = S.sample_questions(spark).select(F.col("question_id").cast("string").alias("question_id"), "question")
    questions = sample.unionByName(S.catalogue_questions(spark, sf))
    hits = RT.tfidf_topk(J.Catalog(spark, sf).index, questions, K)
    return hits.select("question_id", "rank", "doc_id", _score4())


def tfidf_topk_documents(spark: SparkSession, sf: str) -> DataFrame:
    hits = RT.tfidf_topk(J.document_index(spark, sf), S.conversation_questions(spark, sf), K)
    return hits.select("question_id", "rank", "doc_id", _score4())


# --------------------------------------------------------------- vectors ---

def _embedding_questions(spark: SparkSession, sf: str) -> DataFrame:
    # every embedding is also a question: the k-nearest-neighbour graph of the table
    e = S.table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("question_id"), "embedding")


def semantic_topk(spark: SparkSession, sf: str) -> DataFrame:
    hits = SM.semantic_topk(_embedding_questions(spark, sf), J.embedding_docs(spark, sf), K)
    return hits.select("question_id", "rank", "doc_id", _score4())


def semantic_topk_prefilter(spark: SparkSession, sf: str) -> DataFrame:
    hits = SM.semantic_topk(_embedding_questions(spark, sf), J.embedding_docs(spark, sf), K, prefilter=True)
    return hits.select("question_id", "rank", "doc_id", _score4())


def semantic_topk_codes(spark: SparkSession, sf: str) -> DataFrame:
    docs = J.embedding_docs(spark, sf).filter(F.col("doc_type") == "track")
    hits = PQ.pq_topk(_embedding_questions(spark, sf), docs, K)
    return hits.select("question_id", "rank", "doc_id", _score4())


def semantic_topk_learned(spark: SparkSession, sf: str) -> DataFrame:
    """The catalogue's items nearest to each question by vectors that its texts teach."""
    index = J.Catalog(spark, sf).index
    basis = LS.learn_basis(index, DEFAULT.embed_dim)
    questions = S.catalogue_questions(spark, sf)
    # one vector for each row of either side: counted without them, so that each is computed once
    hits = SM.dense_topk(LS.embed_questions(index, basis, questions), LS.embed_documents(index, basis), K,
                         n_questions=questions.count(), n_docs=index.docs.count())
    return hits.select("question_id", "rank", "doc_id", _score4())


def cosine_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Cosine of every embedding to its label centroid (a grouped mean vector)."""
    e = S.table(spark, sf, "embeddings")
    cells = e.select("label", F.posexplode("embedding").alias("i", "x"))
    cent = (cells.groupBy("label", "i").agg(F.sum(F.col("x").cast("double").cast("decimal(20,10)")).alias("s"),
                                            F.count(F.lit(1)).alias("n"))
            .select("label", "i", (F.col("s").cast("double") / F.col("n")).alias("x"))
            .groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c"))
            .select("label", F.transform("c", lambda s: s["x"]).alias("centroid")))
    j = e.join(broadcast_if_small(cent, DEFAULT.broadcast_max_rows), "label")  # one row per label
    return j.select("vec_id", "label", R.round_half_up(cosine("embedding", "centroid"), 10).alias("cosine"))


def embed_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = S.table(spark, sf, "documents").select("doc_id", "text")
    v = E.hashed_embedding(docs, DEFAULT.embed_dim, "doc_id", "text")
    return v.select("doc_id", F.array_join(F.transform("embedding", lambda x: x.cast("string")), ",")
                    .alias("embedding"))


# -------------------------------------------------------------- profiles ---

def _profiles(spark: SparkSession, sf: str):
    songs = P.songs_from_catalog(J.Catalog(spark, sf).unique)
    prof = P.taste_profiles(S.table(spark, sf, "customer"), S.table(spark, sf, "orders"),
                            S.table(spark, sf, "lineitem"), songs)
    return prof, songs


def profile_score(spark: SparkSession, sf: str) -> DataFrame:
    """Score of every (customer, bought song) pair."""
    prof, songs = _profiles(spark, sf)
    pairs = (S.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
             .join(S.table(spark, sf, "orders").select("o_orderkey", "o_custkey"),
                   F.col("l_orderkey") == F.col("o_orderkey"))
             .select(F.col("o_custkey").alias("profile_id"), F.col("l_partkey").alias("song_id"))
             .distinct())
    j = pairs.join(prof, "profile_id").join(songs, "song_id")
    return j.select("profile_id", "song_id", P.score().alias("score"),
                    P.genre_match().alias("genre_match"), P.mood_match().alias("mood_match"))


def profile_topk(spark: SparkSession, sf: str) -> DataFrame:
    prof, songs = _profiles(spark, sf)
    return P.profile_topk(prof, songs, fixed.BATCH_TOP_K).select("profile_id", "rank", "song_id", "score")


def profile_topk_reasons(spark: SparkSession, sf: str) -> DataFrame:
    prof, songs = _profiles(spark, sf)
    top = P.profile_topk(prof, songs, fixed.BATCH_TOP_K)
    return top.select("profile_id", "rank", "song_id", "score",
                      F.array_join(P.reasons(), " | ").alias("reasons"))


def profile_explain(spark: SparkSession, sf: str) -> DataFrame:
    prof, songs = _profiles(spark, sf)
    top = P.profile_topk(prof, songs, fixed.BATCH_TOP_K)
    return top.select("profile_id", "rank", "song_id", P.explanation().alias("explanation"))


def profile_questions(spark: SparkSession, sf: str) -> DataFrame:
    prof, _ = _profiles(spark, sf)
    return PL.profile_question_text(prof).select("profile_id", "question")


def batch_profiles(spark: SparkSession, sf: str) -> DataFrame:
    return PL.batch_profiles(spark, sf)


# ------------------------------------------------- routing and grounding ---

def route_questions(spark: SparkSession, sf: str) -> DataFrame:
    q = RT.validate_questions(S.catalogue_questions(spark, sf)).filter("is_valid")
    return RT.route(q).select("question_id", "retrieval_mode")


def route_override(spark: SparkSession, sf: str) -> DataFrame:
    """A caller's override wins over the router; without one (null) the router decides."""
    q = RT.validate_questions(S.catalogue_questions(spark, sf)).filter("is_valid")
    conv = F.substring_index("question_id", ":", 1).cast("long")
    force = F.when(conv % 4 == 0, F.lit(True)).when(conv % 4 == 1, F.lit(False))
    return RT.route(q, force).select("question_id", "retrieval_mode")


def validate_questions(spark: SparkSession, sf: str) -> DataFrame:
    return RT.validate_questions(S.catalogue_questions(spark, sf)).select("question_id", "question", "is_valid")


def _catalogue_hits(spark: SparkSession, sf: str, cat: J.Catalog | None = None):
    questions = cut_lineage(S.catalogue_questions(spark, sf), "catalogue-questions")
    cat = cat or J.Catalog(spark, sf)
    hits = RT.tfidf_topk(cat.index, questions, K)
    hits = cut_lineage(hits.withColumn("score", R.round_half_up("score", 4)), "catalogue-hits")
    return RT.lookup_hits(hits, cat.hit_docs(hits).filter(S.served()), n_questions=questions.count(), k=K)


def lookup_hits(spark: SparkSession, sf: str) -> DataFrame:
    h = _catalogue_hits(spark, sf)
    return h.select("question_id", "rank", "doc_id", "track_name", "track_artist", "playlist_genre",
                    "energy", "score")


def build_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return G.build_catalog(_catalogue_hits(spark, sf)).select("question_id", "n_hits", "catalog")


def build_prompt(spark: SparkSession, sf: str) -> DataFrame:
    cats = G.build_catalog(_catalogue_hits(spark, sf))
    return G.build_prompt(S.catalogue_questions(spark, sf), cats).select("question_id", "prompt")


def _failing_generator():
    def generate(pairs):
        out = []
        for _, prompt in pairs:
            request = prompt.split(fixed.PROMPT_REQUEST, 1)[1].removesuffix("\n\n" + fixed.PROMPT_INSTRUCTION)
            if "ring" in request:
                raise ValueError("no answer")
            out.append(f"[1] for {len(request)} characters")
        return out
    return generate


def generated_answers(spark: SparkSession, sf: str) -> DataFrame:
    """A batch generator that fails on some questions: those get an error, the others answers."""
    cats = G.build_catalog(_catalogue_hits(spark, sf))
    prompts = G.build_prompt(S.catalogue_questions(spark, sf), cats)
    return G.generate_with(prompts, _failing_generator).select("question_id", "raw_answer", "error")


def names_said(spark: SparkSession, sf: str) -> DataFrame:
    """Catalogue names that answers say although they were not retrieved: a quarter of the
    answers also recommends some item by name."""
    cat = J.Catalog(spark, sf)
    hits = cut_lineage(_catalogue_hits(spark, sf, cat), "said-hits")
    part = S.table(spark, sf, "part").select("p_partkey", "p_name")
    n = part.select(F.count(F.lit(1))).scalar()
    conv = F.substring_index("question_id", ":", 1).cast("long")
    raw = G.stub_answers(hits).withColumn("conv", conv).withColumn("item", (F.col("conv") * 13 + 5) % n)
    more = F.when(F.col("conv") % 4 == 1, F.concat(F.lit(" Also try "), F.coalesce("p_name", F.lit("")))).otherwise("")
    said = raw.join(part, F.col("item") == F.col("p_partkey"), "left").select("question_id", F.concat("raw_answer", more).alias("raw_answer"))
    return M.names_not_retrieved(said, hits, cat.unique)


def verify_citations(spark: SparkSession, sf: str) -> DataFrame:
    """Assistant turns with an appended ``[conv_id mod 15]`` citation, some of them with one
    of 45 digits as well; 12 entries retrieved."""
    conv = S.table(spark, sf, "conversations").filter(F.col("role") == "assistant")
    long = F.when(F.col("conv_id") % 5 == 2, F.concat(F.lit(" ["), F.repeat(F.lit("987654321"), 5), F.lit("] [007]"))).otherwise("")
    ans = conv.select("conv_id", "turn", F.concat(F.col("text"), long, F.lit(" ["),
                                                   (F.col("conv_id") % 15).cast("string"), F.lit("]"))
                      .alias("answer"))
    bad = G.bad_citations("answer", F.lit(K))
    return ans.select("conv_id", "turn", G.refs_text(bad).alias("bad_refs"),
                      F.size(bad).cast("long").alias("n_bad"), G.annotate("answer", bad).alias("answer"))


def grounding_check(spark: SparkSession, sf: str) -> DataFrame:
    cat = J.Catalog(spark, sf)
    hits = cut_lineage(RT.tfidf_topk(cat.index, cut_lineage(S.catalogue_questions(spark, sf), "catalogue-questions"), K), "catalogue-hits")
    return G.grounding_check(hits, cat.hit_docs(hits).filter(S.served()))


def retrieval_stats(spark: SparkSession, sf: str) -> DataFrame:
    q = S.conversation_questions(spark, sf)
    hits = RT.tfidf_topk(J.document_index(spark, sf), q, K).select("question_id", _score4())
    return RT.retrieval_stats(q, hits)


def hit_listing(spark: SparkSession, sf: str) -> DataFrame:
    return G.hit_listing(_catalogue_hits(spark, sf))


def display_features(spark: SparkSession, sf: str) -> DataFrame:
    return G.display_features(_catalogue_hits(spark, sf))


def answer_questions(spark: SparkSession, sf: str) -> DataFrame:
    r = PL.answer_questions(spark, sf, S.catalogue_questions(spark, sf))
    return r.select("question_id", "retrieval_mode", "n_tracks", "track_ids", "answer")


def result_records(spark: SparkSession, sf: str) -> DataFrame:
    """The records of each answer's ``tracks``, one row for each."""
    r = PL.answer_questions(spark, sf, S.catalogue_questions(spark, sf))
    return r.select("question_id", F.posexplode("tracks").alias("pos", "t")).select(
        "question_id", (F.col("pos") + 1).alias("rank"), "t.*")


def stream_questions(spark: SparkSession, sf: str) -> DataFrame:
    from ..streaming.questions import run_question_stream
    out = spark.read.parquet(run_question_stream(spark, sf) + "/answers")
    return out.select("question_id", "retrieval_mode", "n_tracks", "track_ids", "answer")


def stream_retries(spark: SparkSession, sf: str) -> DataFrame:
    """Questions that are sent repeatedly, and a generator that fails for some of them always:
    one answer or one rejection each, whatever the number of sends."""
    from ..streaming.questions import run_question_stream
    out = run_question_stream(spark, sf, n_files=1, repeats=True, generator=_failing_generator, attempts=2)
    answers = spark.read.parquet(out + "/answers").select("question_id", "answer", F.lit(None).cast("string").alias("reason"), "attempt")
    lost = spark.read.parquet(out + "/rejected").select("question_id", F.lit(None).cast("string").alias("answer"), "reason", F.lit(None).cast("int").alias("attempt"))
    return answers.unionByName(lost)


QUERIES: dict[str, Query] = {
    "scan_catalog": scan_catalog,
    "scan_songs_strict": scan_songs_strict,
    "index_roundtrip": index_roundtrip,
    "index_snapshots": index_snapshots,
    "incremental_vocab": incremental_vocab,
    "incremental_rollup": incremental_rollup,
    "safe_numeric": safe_numeric,
    "threshold_buckets": threshold_buckets,
    "track_blurb": track_blurb,
    "track_metadata": track_metadata,
    "dedup_keep_first": dedup_keep_first,
    "artist_rollup": artist_rollup,
    "artist_blurb": artist_blurb,
    "all_documents": all_documents,
    "ingest_stats": ingest_stats,
    "tokenize": tokenize,
    "tfidf_vocab": tfidf_vocab,
    "tfidf_postings": tfidf_postings,
    "tfidf_topk": tfidf_topk,
    "tfidf_topk_documents": tfidf_topk_documents,
    "semantic_topk": semantic_topk,
    "semantic_topk_prefilter": semantic_topk_prefilter,
    "semantic_topk_codes": semantic_topk_codes,
    "semantic_topk_learned": semantic_topk_learned,
    "cosine_pairs": cosine_pairs,
    "embed_documents": embed_documents,
    "profile_score": profile_score,
    "profile_topk": profile_topk,
    "profile_topk_reasons": profile_topk_reasons,
    "profile_explain": profile_explain,
    "profile_questions": profile_questions,
    "batch_profiles": batch_profiles,
    "route_questions": route_questions,
    "validate_questions": validate_questions,
    "lookup_hits": lookup_hits,
    "build_catalog": build_catalog,
    "build_prompt": build_prompt,
    "verify_citations": verify_citations,
    "names_said": names_said,
    "route_override": route_override,
    "result_records": result_records,
    "generated_answers": generated_answers,
    "grounding_check": grounding_check,
    "retrieval_stats": retrieval_stats,
    "hit_listing": hit_listing,
    "display_features": display_features,
    "answer_questions": answer_questions,
    "stream_questions": stream_questions,
    "stream_retries": stream_retries,
}
