"""Independent DuckDB SQL for every registered query (same tables, same column names).

Where the Spark job prunes candidates (TF-IDF popularity union, profile
representatives, blocked dense top-k), the SQL scores every pair by brute force,
so the oracle also checks the pruning.  Text templates come from ``fixed``.
"""

from __future__ import annotations

import re

from ..functions import fixed

K = fixed.TOP_K
KB = fixed.BATCH_TOP_K


# ---------------------------------------------------------------- helpers ---

def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def dbl(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def r1(x: str, d: int) -> str:
    m = dbl(float(10 ** d))
    return (f"(CASE WHEN abs({x}) < CAST(1e15 AS DOUBLE) THEN floor(({x}) * {m} + {dbl(0.5)}) / {m} + {dbl(0.0)} "
            f"ELSE ({x}) END)")


def nn(x: str) -> str:
    return f"(CASE WHEN isnan(CAST({x} AS DOUBLE)) THEN NULL ELSE CAST({x} AS DOUBLE) END)"


def safe(x: str, d: int = 2) -> str:
    return r1(nn(x), d)


def safe_gt(x: str, t: float) -> str:
    return f"COALESCE({safe(x)} > {dbl(t)}, FALSE)"


def bucket3(x: str, hi: float, mid: float, labels: list[str]) -> str:
    return (f"(CASE WHEN {safe_gt(x, hi)} THEN {lit(labels[0])} WHEN {safe_gt(x, mid)} THEN {lit(labels[1])} "
            f"ELSE {lit(labels[2])} END)")


def energy_bucket(x: str) -> str:
    return bucket3(x, fixed.ENERGY_HIGH, fixed.ENERGY_MID, fixed.ENERGY_LABELS)


def track_mood(x: str) -> str:
    return bucket3(x, fixed.VALENCE_HIGH, fixed.VALENCE_MID, fixed.TRACK_MOOD_LABELS)


def cell(x: str) -> str:
    return f"COALESCE(CAST({x} AS VARCHAR), {lit(fixed.MISSING_CELL)})"


def disp(x: str) -> str:
    return f"COALESCE(CAST({safe(x)} AS VARCHAR), {lit(fixed.MISSING_NUMBER)})"


def meta(x: str) -> str:
    return f"COALESCE({safe(x)}, {dbl(0.0)})"


def meta_text(x: str) -> str:
    return f"(CASE WHEN {x} IS NULL OR {x} = 0 THEN '0' ELSE CAST({x} AS VARCHAR) END)"


def fmt(x: str, d: int) -> str:
    return f"printf('%.{d}f', {r1(x, d)})"


def render(template: str, **fields: str) -> str:
    parts, pos = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        if m.start() > pos:
            parts.append(lit(template[pos:m.start()]))
        parts.append(f"({fields[m.group(1)]})")
        pos = m.end()
    if pos < len(template):
        parts.append(lit(template[pos:]))
    return "(" + " || ".join(parts) + ")"


def rank_key(x: str) -> str:
    return r1(x, 10)


STOP = "[" + ", ".join(lit(w) for w in fixed.STOP_WORDS) + "]"
def tokens(t: str) -> str:
    return "regexp_extract_all(lower(" + t + "), '" + fixed.TOKEN_PATTERN + "', 0)"


# white space as Unicode's property and the separators 1C to 1F have it
_SPACE = (r"\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')"


# ------------------------------------------------------------ catalogue ---

CAT = f"""
li AS (
  SELECT l_partkey, COUNT(*) AS n_lines,
         SUM(CAST(l_discount AS DECIMAL(18,6))) AS s_disc,
         SUM(CAST(l_tax AS DECIMAL(18,6))) AS s_tax,
         SUM(CAST(l_quantity AS DECIMAL(18,6))) AS s_qty,
         MIN(l_shipdate) AS first_ship
  FROM lineitem WHERE l_partkey IS NOT NULL GROUP BY l_partkey),
cat0 AS (
  SELECT p.p_partkey AS ordinal,
         'p' || CAST(p.p_partkey AS VARCHAR) AS track_id,
         p.p_name AS track_name,
         p.p_brand AS track_artist,
         p.p_type || ' ' || CAST(p.p_size AS VARCHAR) AS track_album_name,
         strftime(li.first_ship, '%Y-%m-%d') AS track_album_release_date,
         CASE WHEN p.p_partkey % 23 <> 0 THEN p.p_type END AS playlist_genre,
         split_part(p.p_name, ' ', 1) AS playlist_subgenre,
         CAST(LEAST(100, 2 * COALESCE(li.n_lines, 0)) AS DOUBLE) AS track_popularity,
         CASE WHEN p.p_partkey % 17 <> 0 AND li.n_lines > 0
              THEN CAST(li.s_disc AS DOUBLE) / li.n_lines * {dbl(10.0)} END AS energy,
         CAST(p.p_size AS DOUBLE) / {dbl(50.0)} AS danceability,
         CASE WHEN p.p_partkey % 19 <> 0 AND li.n_lines > 0
              THEN CAST(li.s_tax AS DOUBLE) / li.n_lines / {dbl(0.08)} END AS valence,
         CASE WHEN li.n_lines > 0 THEN CAST(li.s_qty AS DOUBLE) / li.n_lines * {dbl(4.0)} END AS tempo,
         CASE WHEN p.p_partkey % 29 <> 0 THEN CAST(p.p_partkey % 120 AS DOUBLE) / {dbl(-8.0)} - {dbl(2.0)} END AS loudness,
         CASE WHEN p.p_partkey % 31 <> 0 THEN CAST(p.p_partkey * 13 % 101 AS DOUBLE) / {dbl(100.0)} END AS acousticness,
         CAST(p.p_partkey * 7 % 101 AS DOUBLE) / {dbl(100.0)} AS instrumentalness,
         CAST(p.p_partkey * 5 % 101 AS DOUBLE) / {dbl(100.0)} AS liveness,
         CASE WHEN p.p_partkey % 13 <> 0 THEN CAST(p.p_partkey * 3 % 101 AS DOUBLE) / {dbl(100.0)} END AS speechiness
  FROM part p LEFT JOIN li ON p.p_partkey = li.l_partkey),
catall AS (
  SELECT * FROM cat0
  UNION ALL SELECT * REPLACE (ordinal + 1000000000 AS ordinal, track_name || ' again' AS track_name) FROM cat0 WHERE ordinal % 37 = 4),
cat AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY ordinal) AS rn FROM catall) WHERE rn = 1)"""

_BLURB = render(
    fixed.TRACK_BLURB,
    track_name=cell("track_name"), track_artist=cell("track_artist"), playlist_genre=cell("playlist_genre"),
    playlist_subgenre=cell("playlist_subgenre"), track_album_name=cell("track_album_name"),
    track_album_release_date=cell("track_album_release_date"),
    energy_desc=energy_bucket("energy"), mood=track_mood("valence"),
    **{c: disp(c) for c in ["danceability", "tempo", "loudness", "acousticness", "instrumentalness",
                            "liveness", "speechiness", "valence", "track_popularity"]})

TRACKS = f"""
tracks AS (
  SELECT {cell('track_id')} AS doc_id, 'track' AS doc_type, {_BLURB} AS blurb,
         substr({cell('track_name')}, 1, 100) AS track_name,
         substr({cell('track_artist')}, 1, 100) AS track_artist,
         substr({cell('track_album_name')}, 1, 100) AS track_album_name,
         substr({cell('playlist_genre')}, 1, 50) AS playlist_genre,
         substr({cell('playlist_subgenre')}, 1, 50) AS playlist_subgenre,
         {meta('track_popularity')} AS track_popularity, {meta('energy')} AS energy,
         {meta('danceability')} AS danceability, {meta('valence')} AS valence, {meta('tempo')} AS tempo,
         {safe('loudness')} AS loudness, {safe('acousticness')} AS acousticness,
         CAST(NULL AS VARCHAR) AS artist, ordinal
  FROM cat)"""


def _avg3(c: str) -> str:
    v = nn(c)
    return r1(f"CASE WHEN COUNT({v}) > 0 THEN CAST(SUM(CAST({v} AS DECIMAL(18,6))) AS DOUBLE) / COUNT({v}) END", 3)


_FEATS = ["energy", "danceability", "valence", "tempo", "acousticness", "instrumentalness", "speechiness"]


def _first_seen(col: str, out: str) -> str:
    return f"""
{out} AS (
  SELECT track_artist, string_agg({col}, ', ' ORDER BY first_ord) AS {out}
  FROM (SELECT track_artist, {col}, MIN(ordinal) AS first_ord FROM base
        WHERE {col} IS NOT NULL GROUP BY track_artist, {col})
  GROUP BY track_artist)"""


_ARTIST_MOOD = (f"(CASE WHEN COALESCE(valence_avg > {dbl(fixed.VALENCE_HIGH)}, FALSE) THEN {lit(fixed.ARTIST_MOOD_LABELS[0])} "
                f"WHEN COALESCE(valence_avg > {dbl(fixed.VALENCE_MID)}, FALSE) THEN {lit(fixed.ARTIST_MOOD_LABELS[1])} "
                f"ELSE {lit(fixed.ARTIST_MOOD_LABELS[2])} END)")

ROLLUP = f"""
base AS (SELECT * FROM cat WHERE track_artist IS NOT NULL),
st AS (
  SELECT track_artist, COUNT(*) AS n_tracks,
         {", ".join(f"{_avg3(c)} AS {c}_avg" for c in _FEATS)}
  FROM base GROUP BY track_artist),
{_first_seen('playlist_genre', 'genres').strip()},
{_first_seen('playlist_subgenre', 'subgenres').strip()},
rollup AS (
  SELECT st.track_artist, n_tracks, {", ".join(f"{c}_avg" for c in _FEATS)},
         {_ARTIST_MOOD} AS mood,
         COALESCE(genres.genres, '') AS genres, COALESCE(subgenres.subgenres, '') AS subgenres
  FROM st LEFT JOIN genres USING (track_artist) LEFT JOIN subgenres USING (track_artist))"""


def _stat(c: str) -> str:
    return f"COALESCE(CAST({c} AS VARCHAR), 'nan')"


ARTISTS = f"""
artists AS (
  SELECT {lit(fixed.ARTIST_DOC_PREFIX)} || track_artist AS doc_id, 'artist' AS doc_type,
         {render(fixed.ARTIST_BLURB, artist='track_artist', n_tracks='CAST(n_tracks AS VARCHAR)',
                 genres='genres', subgenres='subgenres', energy=_stat('energy_avg'),
                 danceability=_stat('danceability_avg'), valence=_stat('valence_avg'), mood='mood',
                 tempo=_stat('tempo_avg'))} AS blurb,
         track_artist AS artist
  FROM rollup)"""

DOCS = f"""{CAT},
{TRACKS.strip()},
{ROLLUP.strip()},
{ARTISTS.strip()},
alldocs AS (
  SELECT doc_id, doc_type, blurb, track_name, track_artist, track_album_name, playlist_genre,
         playlist_subgenre, track_popularity, energy, danceability, valence, tempo, loudness,
         acousticness, artist, ordinal FROM tracks
  UNION ALL
  SELECT doc_id, doc_type, blurb, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
         NULL, artist, NULL FROM artists),
docs AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY doc_type = 'artist', ordinal NULLS FIRST,
                                 artist NULLS FIRST) AS rn
    FROM alldocs) WHERE rn = 1),
served AS (SELECT * FROM docs WHERE COALESCE(ordinal % 31 <> 5, TRUE))"""


# ----------------------------------------------------------- text index ---

def tfidf(prefix: str, corpus: str) -> str:
    """CTEs {p}tm, {p}cnt, {p}vocab, {p}post over corpus(doc_id, text, popularity)."""
    p = prefix
    toks = tokens("text")
    return f"""
{p}tk AS (SELECT doc_id, list_filter({toks}, lambda t: NOT list_contains({STOP}, t)) AS toks FROM {corpus}),
{p}tm AS (SELECT doc_id, toks || list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1]) AS terms
          FROM {p}tk),
{p}cnt AS (SELECT doc_id, term, COUNT(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM {p}tm) GROUP BY doc_id, term),
{p}nd AS (SELECT COUNT(*) AS n FROM {corpus}),
{p}voc AS (SELECT term, COUNT(*) AS df, CAST(SUM(tf) AS BIGINT) AS cf FROM {p}cnt GROUP BY term
           ORDER BY cf DESC, term ASC LIMIT {fixed.VOCAB_SIZE}),
{p}vocab AS (SELECT term, df, cf, ln(CAST(n + 1 AS DOUBLE) / CAST(df + 1 AS DOUBLE)) + {dbl(1.0)} AS idf
             FROM {p}voc CROSS JOIN {p}nd),
{p}w AS (SELECT c.doc_id, c.term, CAST(c.tf AS DOUBLE) * v.idf AS w FROM {p}cnt c JOIN {p}vocab v USING (term)),
{p}post AS (SELECT doc_id, term, w / sqrt(SUM(w * w) OVER (PARTITION BY doc_id)) AS weight FROM {p}w)"""


# the question tables are shaped like a corpus: doc_id (= question id), text
def tfidf_q(p: str, qtable: str) -> str:
    # questions are tokenised with the same CTEs; vocabulary/idf come from the corpus
    q = p + "q"
    toks = tokens("text")
    return f"""
{q}tk AS (SELECT doc_id, list_filter({toks}, lambda t: NOT list_contains({STOP}, t)) AS toks FROM {qtable}),
{q}tm AS (SELECT doc_id, toks || list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1]) AS terms
          FROM {q}tk),
{q}cnt AS (SELECT doc_id, term, COUNT(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM {q}tm) GROUP BY doc_id, term),
{q}w AS (SELECT c.doc_id, c.term, CAST(c.tf AS DOUBLE) * v.idf AS w FROM {q}cnt c JOIN {p}vocab v USING (term)),
{q}post AS (SELECT doc_id, term, w / sqrt(SUM(w * w) OVER (PARTITION BY doc_id)) AS weight FROM {q}w)"""


def hybrid_topk(p: str, corpus: str, qtable: str, k: int, out: str) -> str:
    """Full chain: corpus index, question vectors, brute-force top-k."""
    return f"""{tfidf(p, corpus).strip()},
{tfidf_q(p, qtable).strip()},
{p}qv AS (SELECT doc_id AS question_id, term, weight AS qweight FROM {p}qpost),
{p}m AS (SELECT q.question_id, d.doc_id, SUM(q.qweight * d.weight) AS cosine
         FROM {p}qv q JOIN {p}post d USING (term) GROUP BY q.question_id, d.doc_id),
{p}all AS (SELECT q.doc_id AS question_id, c.doc_id, COALESCE(m.cosine, {dbl(0.0)}) AS cosine, c.popularity
           FROM {qtable} q CROSS JOIN {corpus} c
           LEFT JOIN {p}m m ON m.question_id = q.doc_id AND m.doc_id = c.doc_id),
{p}sc AS (SELECT *, {dbl(fixed.WEIGHT_COSINE)} * cosine + {dbl(fixed.WEIGHT_POPULARITY)} * (popularity / {dbl(100.0)}) AS score
          FROM {p}all),
{out} AS (SELECT question_id, rank, doc_id, {r1('score', 4)} AS score FROM (
            SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY {rank_key('score')} DESC, doc_id ASC) AS rank
            FROM {p}sc) WHERE rank <= {k})"""


CAT_CORPUS = f"""
ccorpus AS (
  SELECT {cell('track_id')} AS doc_id,
         concat_ws(' ', {cell('track_name')}, {cell('track_artist')}, {cell('playlist_genre')}, {cell('playlist_subgenre')}) AS text,
         COALESCE({nn('track_popularity')}, {dbl(0.0)}) AS popularity
  FROM cat)"""

DOC_CORPUS = f"""
dcorpus AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, d.text,
         CAST(COALESCE(l.quality, 0) * 100 AS DOUBLE) AS popularity
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

CAT_Q = """
catq AS (SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS doc_id,
                CASE WHEN conv_id % 29 = 3 THEN chr(12288) || chr(160) || ' '
                     ELSE concat_ws(' ', c.text, p.p_name, CASE WHEN conv_id % 3 = 0 THEN 'top' END) END AS text
         FROM conversations c LEFT JOIN part p ON p.p_partkey = (c.conv_id * 7 + c.turn * 3) % (SELECT COUNT(*) FROM part)
         WHERE role = 'user')"""

SAMPLE_Q = CAT_Q.strip() + ",\nsampleq AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{i + 1}', {lit(q)})" for i, q in enumerate(fixed.SAMPLE_QUESTIONS)) + ") AS t(doc_id, text) UNION ALL SELECT doc_id, text FROM catq)"

CONV_Q = """
convq AS (SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS doc_id, text
          FROM conversations WHERE role = 'user')"""


# ------------------------------------------------------------- profiles ---

PROFILES = f"""
songs AS (
  SELECT ordinal AS song_id, track_name AS title, track_artist AS artist, playlist_genre AS genre,
         {track_mood('valence')} AS mood, {meta('energy')} AS energy, {meta('valence')} AS valence
  FROM cat),
bought AS (
  SELECT o.o_custkey AS profile_id, s.genre, s.energy, s.valence
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN songs s ON l.l_partkey = s.song_id),
fav AS (
  SELECT profile_id, genre AS favorite_genre FROM (
    SELECT profile_id, genre, row_number() OVER (PARTITION BY profile_id ORDER BY n DESC, genre ASC) AS rn
    FROM (SELECT profile_id, genre, COUNT(*) AS n FROM bought WHERE genre IS NOT NULL GROUP BY profile_id, genre))
  WHERE rn = 1),
feats AS (
  SELECT profile_id,
         {r1('CAST(SUM(CAST(energy AS DECIMAL(18,6))) AS DOUBLE) / COUNT(energy)', 2)} AS target_energy,
         {r1('CAST(SUM(CAST(valence AS DECIMAL(18,6))) AS DOUBLE) / COUNT(valence)', 2)} AS target_valence
  FROM bought GROUP BY profile_id),
prof AS (
  SELECT c.c_custkey AS profile_id,
         COALESCE(fav.favorite_genre, '') AS favorite_genre,
         CASE WHEN feats.target_valence IS NULL THEN '' ELSE {track_mood('feats.target_valence')} END AS favorite_mood,
         COALESCE(feats.target_energy, {dbl(0.5)}) AS target_energy,
         COALESCE(feats.target_valence, {dbl(0.5)}) AS target_valence
  FROM customer c LEFT JOIN feats ON c.c_custkey = feats.profile_id LEFT JOIN fav ON c.c_custkey = fav.profile_id)"""

_GM = "COALESCE(s.genre = p.favorite_genre, FALSE)"
_MM = "COALESCE(s.mood = p.favorite_mood, FALSE)"
_EP = f"{dbl(2.0)} * ({dbl(1.0)} - abs(s.energy - p.target_energy))"
_SCORE = (f"(CASE WHEN {_GM} THEN {dbl(1.0)} ELSE {dbl(0.0)} END + CASE WHEN {_MM} THEN {dbl(1.0)} ELSE {dbl(0.0)} END "
          f"+ {_EP})")

PTOP = f"""
ptop AS (
  SELECT * FROM (
    SELECT p.profile_id, s.song_id, s.genre, s.mood, s.energy, p.target_energy, {_GM} AS gm, {_MM} AS mm,
           {_SCORE} AS score,
           row_number() OVER (PARTITION BY p.profile_id ORDER BY {rank_key(_SCORE)} DESC, s.song_id ASC) AS rank
    FROM prof p CROSS JOIN songs s)
  WHERE rank <= {KB})"""

_ENERGY_TXT = "CAST(energy AS VARCHAR)"
_TARGET_TXT = "CAST(target_energy AS VARCHAR)"

REASONS = ("concat_ws(' | ', "
           f"CASE WHEN gm THEN {render(fixed.REASON_GENRE, genre='genre')} END, "
           f"CASE WHEN mm THEN {render(fixed.REASON_MOOD, mood='mood')} END, "
           f"{render(fixed.REASON_ENERGY, sim=fmt('2.0::DOUBLE * (1.0::DOUBLE - abs(energy - target_energy))', 2), song_energy=_ENERGY_TXT, target_energy=_TARGET_TXT)})")

EXPLAIN = ("concat_ws('; ', "
           f"CASE WHEN gm THEN {render(fixed.EXPLAIN_GENRE, genre='genre')} END, "
           f"CASE WHEN mm THEN {render(fixed.EXPLAIN_MOOD, mood='mood')} END, "
           f"{render(fixed.EXPLAIN_ENERGY, sim=fmt('1.0::DOUBLE - abs(energy - target_energy)', 2), song_energy=_ENERGY_TXT, target_energy=_TARGET_TXT)})")

BUILTIN = "builtin AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i + 1}, {lit(label)}, {lit(g)}, {dbl(v)}, {dbl(e)})"
    for i, (label, g, v, e) in enumerate(fixed.BUILTIN_PROFILES)) + ") AS t(profile_id, label, genre, valence, energy))"


# ------------------------------------------------------------ grounding ---

def catalogue_hits(qtable: str, k: int = K) -> str:
    """TF-IDF hits of ``qtable`` over the catalogue, joined to track documents."""
    return f"""{DOCS},
{CAT_CORPUS.strip()},
{qtable.strip()},
{hybrid_topk('c', 'ccorpus', qtable.strip().split(' ')[0], k, 'hits').strip()},
hd AS (SELECT h.question_id, row_number() OVER (PARTITION BY h.question_id ORDER BY h.rank) AS rank, h.doc_id, h.score, d.* EXCLUDE (doc_id)
       FROM hits h JOIN served d ON h.doc_id = d.doc_id WHERE d.doc_type = 'track')"""


_ENTRY = render(fixed.CATALOG_ENTRY, rank="CAST(rank AS VARCHAR)",
                track_name="COALESCE(track_name, 'Unknown')", track_artist="COALESCE(track_artist, 'Unknown')",
                playlist_genre="COALESCE(playlist_genre, '')", playlist_subgenre="COALESCE(playlist_subgenre, '')",
                energy=meta_text("energy"), tempo=meta_text("tempo"), score=fmt("score", 3),
                blurb="COALESCE(blurb, '')")

CATALOGS = f"""
cats AS (SELECT question_id, COUNT(*) AS n_hits, string_agg({_ENTRY}, '\n\n' ORDER BY rank) AS catalog
         FROM hd GROUP BY question_id)"""


def bad_refs(answer: str, n: str) -> str:
    # digits without leading zeros; a number is outside 1..n when it is 0, too long or too large
    cited = (f"list_distinct(list_transform(regexp_extract_all({answer}, '\\[([0-9]+)\\]', 1), "
             f"lambda s: CASE WHEN ltrim(s, '0') = '' THEN '0' ELSE ltrim(s, '0') END))")
    wrong = f"list_filter({cited}, lambda s: s = '0' OR length(s) > 18 OR TRY_CAST(s AS BIGINT) > {n})"
    keyed = f"list_sort(list_transform({wrong}, lambda s: lpad(CAST(length(s) AS VARCHAR), 6, '0') || ':' || s))"
    return f"list_transform({keyed}, lambda s: split_part(s, ':', 2))"


def annotate(answer: str, bad: str) -> str:
    note = ("'\n\n⚠️ Note: Response referenced catalog entries [' || array_to_string(" + bad +
            ", ', ') || '] which are outside the retrieved set.'")
    return f"(CASE WHEN len({bad}) > 0 THEN {answer} || {note} ELSE {answer} END)"


_STUB = render(fixed.STUB_ANSWER_LINE, rank="CAST(rank AS VARCHAR)",
               track_name="COALESCE(track_name, 'Unknown')", track_artist="COALESCE(track_artist, 'Unknown')")

_ROUTE = "regexp_matches(lower(question), '" + "|".join(fixed.ROUTING_SIGNALS) + "')"


def hashed(table: str, id_col: str, text_col: str, out: str, dim: int = 64) -> str:
    """Dense hashed bag-of-words vectors (integer counts) as ``{out}(id, v double[])``."""
    toks = tokens(text_col)
    return f"""
{out}_t AS (SELECT {id_col} AS id, unnest({toks}) AS tok FROM {table}),
{out}_h AS (SELECT id, CAST('0x' || substr(md5(tok), 1, 8) AS BIGINT) AS h FROM {out}_t),
{out}_b AS (SELECT id, h % {dim} AS bucket,
                   SUM(CASE WHEN (h // {dim}) % 2 = 0 THEN {dbl(1.0)} ELSE {dbl(-1.0)} END) AS v
            FROM {out}_h GROUP BY id, h % {dim}),
{out}_g AS (SELECT t.{id_col} AS id, r.i, COALESCE(b.v, {dbl(0.0)}) AS v
            FROM {table} t CROSS JOIN range(0, {dim}) r(i)
            LEFT JOIN {out}_b b ON b.id = t.{id_col} AND b.bucket = r.i),
{out} AS (SELECT id, list(v ORDER BY i) AS v FROM {out}_g GROUP BY id)"""


def cos(a: str, b: str) -> str:
    den = f"(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"
    return f"(CASE WHEN {den} > 0 THEN list_dot_product({a}, {b}) / {den} ELSE {dbl(0.0)} END)"


def answers_cte() -> str:
    return f"""WITH {DOCS},
{CAT_CORPUS.strip()},
{CAT_Q.strip()},
vq AS (SELECT doc_id, {strip('text')} AS question FROM catq),
valid AS (SELECT doc_id, question, question AS text,
                 CASE WHEN {_ROUTE} THEN 'tfidf' ELSE 'semantic' END AS retrieval_mode
          FROM vq WHERE length(question) > 0),
tq AS (SELECT doc_id, text FROM valid WHERE retrieval_mode = 'tfidf'),
sq AS (SELECT doc_id, question FROM valid WHERE retrieval_mode = 'semantic'),
{hybrid_topk('c', 'ccorpus', 'tq', K, 'thits').strip()},
{hashed('served', 'doc_id', 'blurb', 'de').strip()},
{hashed('sq', 'doc_id', 'question', 'qe').strip()},
near AS (SELECT * FROM (
           SELECT q.id AS question_id, d.id AS doc_id, {cos('q.v', 'd.v')} AS score,
                  row_number() OVER (PARTITION BY q.id ORDER BY {rank_key(cos('q.v', 'd.v'))} DESC, d.id ASC) AS r
           FROM qe q CROSS JOIN de d) WHERE r <= {fixed.SEMANTIC_OVERFETCH * K}),
shits AS (SELECT question_id, rank, doc_id, score FROM (
            SELECT n.*, row_number() OVER (PARTITION BY question_id ORDER BY {rank_key('score')} DESC, n.doc_id ASC) AS rank
            FROM near n JOIN served d ON n.doc_id = d.doc_id WHERE d.doc_type = 'track') WHERE rank <= {K}),
hits AS (SELECT question_id, rank, doc_id, score FROM thits
         UNION ALL SELECT question_id, rank, doc_id, {r1('score', 4)} FROM shits),
hd AS (SELECT h.question_id, row_number() OVER (PARTITION BY h.question_id ORDER BY h.rank) AS rank, h.score, d.*
       FROM hits h JOIN served d ON h.doc_id = d.doc_id WHERE d.doc_type = 'track'),
agg AS (SELECT question_id, COUNT(*) AS n_tracks, string_agg(doc_id, ',' ORDER BY rank) AS track_ids,
               string_agg({_STUB}, '\n' ORDER BY rank) AS raw
        FROM hd GROUP BY question_id)"""


def answers_sql() -> str:
    return f"""{answers_cte()}
SELECT v.doc_id AS question_id, v.retrieval_mode, CAST(COALESCE(a.n_tracks, 0) AS BIGINT) AS n_tracks,
       COALESCE(a.track_ids, '') AS track_ids,
       COALESCE({annotate('a.raw', bad_refs('a.raw', 'a.n_tracks'))}, {lit(fixed.NO_HITS_ANSWER)}) AS answer
FROM valid v LEFT JOIN agg a ON a.question_id = v.doc_id"""


# -------------------------------------------------------------- queries ---

def _q(sql: str) -> str:
    return sql.strip()


def _build() -> dict[str, str]:
    o: dict[str, str] = {}
    cat_cols = ("ordinal, track_id, track_name, track_artist, track_album_name, track_album_release_date, "
                "playlist_genre, playlist_subgenre, track_popularity, energy, danceability, valence, tempo")
    o["scan_catalog"] = f"WITH {CAT} SELECT {cat_cols} FROM catall"
    o["scan_songs_strict"] = f"""WITH {CAT}
SELECT CAST(ordinal AS VARCHAR) AS id, track_name AS title, track_artist AS artist,
       COALESCE(playlist_genre, '') AS genre, {track_mood('valence')} AS mood, {meta('energy')} AS energy,
       {meta('tempo')} AS tempo_bpm, {meta('valence')} AS valence, {meta('danceability')} AS danceability,
       COALESCE({safe('acousticness')}, {dbl(0.0)}) AS acousticness
FROM cat"""
    vocab_out = f"SELECT term, df, cf, {r1('idf', 10)} AS idf FROM {{p}}vocab"
    o["index_roundtrip"] = f"WITH {CAT},\n{CAT_CORPUS.strip()},\n{tfidf('c', 'ccorpus').strip()}\n" + vocab_out.format(p="c")
    o["incremental_vocab"] = o["index_roundtrip"]
    small = tfidf("s", "ccorpus").replace(f"LIMIT {fixed.VOCAB_SIZE}", "LIMIT 200")
    o["index_snapshots"] = f"""WITH {DOCS},
{CAT_CORPUS.strip()},
{tfidf('c', 'ccorpus').strip()},
{small.strip()},
parts AS (
  SELECT 1 AS snapshot, 'docs' AS part, COUNT(*) AS n_rows FROM docs UNION ALL SELECT 2, 'docs', COUNT(*) FROM docs
  UNION ALL SELECT 1, 'popularity', COUNT(*) FROM ccorpus UNION ALL SELECT 2, 'popularity', COUNT(*) FROM ccorpus
  UNION ALL SELECT 1, 'vocab', COUNT(*) FROM svocab UNION ALL SELECT 2, 'vocab', COUNT(*) FROM cvocab
  UNION ALL SELECT 1, 'postings', COUNT(*) FROM spost UNION ALL SELECT 2, 'postings', COUNT(*) FROM cpost)
SELECT * FROM parts"""
    o["safe_numeric"] = (f"WITH {CAT} SELECT track_id, " + ", ".join(
        f"{safe(c)} AS {c}" for c in ["track_popularity", "energy", "danceability", "valence", "tempo"]) + " FROM catall")
    o["threshold_buckets"] = (f"WITH {CAT} SELECT track_id, {energy_bucket('energy')} AS energy_desc, "
                              f"{track_mood('valence')} AS mood FROM catall")
    o["track_blurb"] = f"WITH {CAT},\n{TRACKS.strip()}\nSELECT doc_id, blurb FROM tracks"
    o["track_metadata"] = (f"WITH {CAT},\n{TRACKS.strip()}\nSELECT doc_id, doc_type, track_name, track_artist, "
                           "track_album_name, playlist_genre, playlist_subgenre, track_popularity, energy, "
                           "danceability, valence, tempo FROM tracks")
    order = ("l_partkey NULLS FIRST, l_suppkey NULLS FIRST, l_quantity NULLS FIRST, l_extendedprice NULLS FIRST, "
             "l_discount NULLS FIRST, l_tax NULLS FIRST, l_returnflag NULLS FIRST, l_linestatus NULLS FIRST, "
             "l_shipdate NULLS FIRST")
    o["dedup_keep_first"] = f"""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity + 0.0 AS l_quantity,
       l_extendedprice + 0.0 AS l_extendedprice, l_discount + 0.0 AS l_discount, l_tax + 0.0 AS l_tax,
       l_returnflag, l_linestatus, l_shipdate
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {order}) AS rn FROM lineitem)
WHERE rn = 1"""
    o["artist_rollup"] = f"WITH {CAT},\n{ROLLUP.strip()}\nSELECT * FROM rollup"
    o["incremental_rollup"] = o["artist_rollup"]
    o["artist_blurb"] = f"WITH {CAT},\n{ROLLUP.strip()},\n{ARTISTS.strip()}\nSELECT doc_id, blurb FROM artists"
    o["all_documents"] = f"WITH {DOCS}\nSELECT doc_id, doc_type, blurb, artist FROM docs"
    o["ingest_stats"] = f"""WITH {DOCS},
{CAT_CORPUS.strip()},
{tfidf('c', 'ccorpus').strip()}
SELECT (SELECT COUNT(*) FROM catall) AS n_catalog_rows,
       (SELECT COUNT(DISTINCT track_id) + MAX(CASE WHEN track_id IS NULL THEN 1 ELSE 0 END) FROM catall) AS n_unique_tracks,
       (SELECT COUNT(*) FROM docs WHERE doc_type = 'track') AS n_track_docs,
       (SELECT COUNT(*) FROM docs WHERE doc_type = 'artist') AS n_artist_docs,
       (SELECT COUNT(*) FROM docs) AS n_docs,
       (SELECT COUNT(*) FROM cvocab) AS n_vocab_terms,
       (SELECT COUNT(*) FROM cpost) AS n_postings,
       (SELECT COUNT(*) FROM alldocs) - (SELECT COUNT(*) FROM docs) AS n_dropped_ids"""
    toks = tokens("text")
    o["tokenize"] = f"""WITH {DOC_CORPUS.strip()},
{tfidf('d', 'dcorpus').strip()}
SELECT doc_id, CAST(len(list_filter(terms, lambda t: NOT contains(t, ' '))) AS BIGINT) AS n_tokens,
       CAST(len(terms) AS BIGINT) AS n_terms, CAST(len(list_distinct(terms)) AS BIGINT) AS n_distinct_terms
FROM dtm"""
    o["tfidf_vocab"] = f"WITH {DOC_CORPUS.strip()},\n{tfidf('d', 'dcorpus').strip()}\n" + vocab_out.format(p="d")
    o["tfidf_postings"] = (f"WITH {DOC_CORPUS.strip()},\n{tfidf('d', 'dcorpus').strip()}\n"
                           f"SELECT doc_id, term, {r1('weight', 10)} AS weight FROM dpost")
    o["tfidf_topk"] = (f"WITH {CAT},\n{CAT_CORPUS.strip()},\n{SAMPLE_Q},\n"
                       f"{hybrid_topk('c', 'ccorpus', 'sampleq', K, 'hits').strip()}\n"
                       "SELECT question_id, rank, doc_id, score FROM hits")
    o["tfidf_topk_documents"] = (f"WITH {DOC_CORPUS.strip()},\n{CONV_Q.strip()},\n"
                                 f"{hybrid_topk('d', 'dcorpus', 'convq', K, 'hits').strip()}\n"
                                 "SELECT question_id, rank, doc_id, score FROM hits")
    emb = """ed AS (SELECT vec_id AS doc_id, CAST(embedding AS DOUBLE[]) AS v,
                   CASE WHEN label < 8 THEN 'track' ELSE 'artist' END AS doc_type FROM embeddings),
pairs AS (SELECT q.doc_id AS question_id, d.doc_id, d.doc_type, {cos} AS score FROM ed q CROSS JOIN ed d)"""
    emb = emb.replace("{cos}", cos("q.v", "d.v"))
    o["semantic_topk"] = f"""WITH {emb},
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY {rank_key('score')} DESC, doc_id) AS r
                        FROM pairs) WHERE r <= {fixed.SEMANTIC_OVERFETCH * K})
SELECT question_id, rank, doc_id, {r1('score', 4)} AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY {rank_key('score')} DESC, doc_id) AS rank
  FROM near WHERE doc_type = 'track') WHERE rank <= {K}"""
    o["semantic_topk_prefilter"] = f"""WITH {emb}
SELECT question_id, rank, doc_id, {r1('score', 4)} AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY {rank_key('score')} DESC, doc_id) AS rank
  FROM pairs WHERE doc_type = 'track') WHERE rank <= {K}"""
    # codes only choose what is compared: their answers are the exact ones
    o["semantic_topk_codes"] = o["semantic_topk_prefilter"]
    o["cosine_pairs"] = f"""WITH cells AS (
  SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
cent AS (SELECT label, i, CAST(SUM(CAST(CAST(x AS DOUBLE) AS DECIMAL(20,10))) AS DOUBLE) / COUNT(*) AS x
         FROM cells GROUP BY label, i),
centroid AS (SELECT label, list(x ORDER BY i) AS c FROM cent GROUP BY label)
SELECT e.vec_id, e.label, {r1(cos('CAST(e.embedding AS DOUBLE[])', 'c.c'), 10)} AS cosine
FROM embeddings e JOIN centroid c ON e.label = c.label"""
    o["embed_documents"] = f"""WITH {hashed('documents', 'doc_id', 'text', 'emb').strip()}
SELECT id AS doc_id, array_to_string(list_transform(v, lambda x: CAST(x AS VARCHAR)), ',') AS embedding FROM emb"""
    o["profile_score"] = f"""WITH {CAT},
{PROFILES.strip()},
pairs AS (SELECT DISTINCT o.o_custkey AS profile_id, l.l_partkey AS song_id
          FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)
SELECT x.profile_id, x.song_id, {_SCORE} AS score, {_GM} AS genre_match, {_MM} AS mood_match
FROM pairs x JOIN prof p ON x.profile_id = p.profile_id JOIN songs s ON x.song_id = s.song_id"""
    o["profile_topk"] = f"WITH {CAT},\n{PROFILES.strip()},\n{PTOP.strip()}\nSELECT profile_id, rank, song_id, score FROM ptop"
    o["profile_topk_reasons"] = (f"WITH {CAT},\n{PROFILES.strip()},\n{PTOP.strip()}\n"
                                 f"SELECT profile_id, rank, song_id, score, {REASONS} AS reasons FROM ptop")
    o["profile_explain"] = (f"WITH {CAT},\n{PROFILES.strip()},\n{PTOP.strip()}\n"
                            f"SELECT profile_id, rank, song_id, {EXPLAIN} AS explanation FROM ptop")
    o["profile_questions"] = (f"WITH {CAT},\n{PROFILES.strip()}\nSELECT profile_id, "
                              f"{render(fixed.PROFILE_QUESTION, genre='favorite_genre', energy='CAST(target_energy AS VARCHAR)', valence='CAST(target_valence AS VARCHAR)')} AS question FROM prof")
    bq = ("bq AS (SELECT profile_id AS doc_id, "
          f"{render(fixed.PROFILE_QUESTION, genre='genre', energy='CAST(energy AS VARCHAR)', valence='CAST(valence AS VARCHAR)')}"
          " AS text FROM builtin)")
    line = render(fixed.BATCH_LINE, rank="CAST(rank AS VARCHAR)", track_name="COALESCE(track_name, 'Unknown')",
                  track_artist="COALESCE(track_artist, 'Unknown')", playlist_genre="COALESCE(playlist_genre, '')",
                  score=fmt("score", 4), energy=meta_text("hd.energy"))
    o["batch_profiles"] = f"""WITH {DOCS},
{CAT_CORPUS.strip()},
{BUILTIN},
{bq},
{hybrid_topk('c', 'ccorpus', 'bq', KB, 'hits').strip()},
hd AS (SELECT h.question_id, row_number() OVER (PARTITION BY h.question_id ORDER BY h.rank) AS rank, h.score, d.track_name, d.track_artist, d.playlist_genre, d.energy
       FROM hits h JOIN docs d ON h.doc_id = d.doc_id WHERE d.doc_type = 'track')
SELECT b.profile_id, b.label, COALESCE(hd.rank, 0) AS rank, COALESCE({line}, {lit(fixed.NO_RESULTS_LINE)}) AS line
FROM builtin b LEFT JOIN hd ON hd.question_id = b.profile_id"""
    asked = f"WITH {CAT_Q.strip()},\nq AS (SELECT doc_id AS question_id, {strip('text')} AS question FROM catq)"
    o["route_questions"] = f"""{asked}
SELECT question_id, CASE WHEN {_ROUTE} THEN 'tfidf' ELSE 'semantic' END AS retrieval_mode
FROM q WHERE length(question) > 0"""
    o["route_override"] = f"""{asked}
SELECT question_id, CASE CAST(split_part(question_id, ':', 1) AS BIGINT) % 4 WHEN 0 THEN 'tfidf' WHEN 1 THEN 'semantic'
                    ELSE CASE WHEN {_ROUTE} THEN 'tfidf' ELSE 'semantic' END END AS retrieval_mode
FROM q WHERE length(question) > 0"""
    o["validate_questions"] = f"{asked}\nSELECT question_id, question, COALESCE(length(question), 0) > 0 AS is_valid FROM q"
    o["lookup_hits"] = (f"WITH {catalogue_hits(CAT_Q)}\n"
                        "SELECT question_id, rank, doc_id, track_name, track_artist, playlist_genre, energy, score FROM hd")
    o["build_catalog"] = f"WITH {catalogue_hits(CAT_Q)},\n{CATALOGS.strip()}\nSELECT question_id, n_hits, catalog FROM cats"
    prompt = ("'RETRIEVED TRACK CATALOG (' || CAST(c.n_hits AS VARCHAR) || ' tracks):' || '\n\n' || c.catalog || '\n\n' || "
              f"{lit(fixed.PROMPT_REQUEST)} || q.text || '\n\n' || {lit(fixed.PROMPT_INSTRUCTION)}")
    o["build_prompt"] = (f"WITH {catalogue_hits(CAT_Q)},\n{CATALOGS.strip()}\n"
                         f"SELECT q.doc_id AS question_id, {prompt} AS prompt FROM catq q JOIN cats c ON c.question_id = q.doc_id")
    o["generated_answers"] = f"""WITH {catalogue_hits(CAT_Q)}
SELECT q.doc_id AS question_id,
       CASE WHEN NOT contains(q.text, 'ring') THEN '[1] for ' || CAST(length(q.text) AS VARCHAR) || ' characters' END AS raw_answer,
       CASE WHEN contains(q.text, 'ring') THEN 'ValueError: no answer' END AS error
FROM catq q WHERE q.doc_id IN (SELECT question_id FROM hd)"""
    o["names_said"] = f"""WITH {catalogue_hits(CAT_Q)},
raw AS (SELECT question_id, CAST(split_part(question_id, ':', 1) AS BIGINT) AS conv, string_agg({_STUB}, '\n' ORDER BY rank) AS raw
        FROM hd GROUP BY question_id),
said AS (SELECT r.question_id, raw || CASE WHEN conv % 4 = 1 THEN ' Also try ' || COALESCE(p.p_name, '') ELSE '' END AS text
         FROM raw r LEFT JOIN part p ON p.p_partkey = (r.conv * 13 + 5) % (SELECT COUNT(*) FROM part)),
saidt AS (SELECT question_id, {tokens('text')} AS t FROM said),
names AS (SELECT DISTINCT array_to_string(t, ' ') AS phrase, len(t) AS n FROM (SELECT {tokens('track_name')} AS t FROM cat) WHERE len(t) > 0),
lens AS (SELECT DISTINCT n FROM names),
pos AS (SELECT question_id, t, unnest(range(1, len(t) + 1)) AS i FROM saidt),
grams AS (SELECT question_id, i, n, array_to_string(t[i:i + n - 1], ' ') AS phrase FROM pos, lens WHERE i + n - 1 <= len(t)),
found AS (SELECT g.* FROM grams g JOIN names m ON g.phrase = m.phrase AND g.n = m.n),
best AS (SELECT * FROM found a WHERE NOT EXISTS (
           SELECT 1 FROM found b WHERE b.question_id = a.question_id AND b.n > a.n AND b.i <= a.i AND b.i + b.n >= a.i + a.n)),
own AS (SELECT DISTINCT question_id, array_to_string({tokens('track_name')}, ' ') AS phrase FROM hd)
SELECT b.question_id, b.phrase, COUNT(*) AS n_said FROM best b
WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.question_id = b.question_id AND o.phrase = b.phrase)
GROUP BY b.question_id, b.phrase"""
    o["verify_citations"] = f"""WITH a AS (
  SELECT conv_id, turn, text || CASE WHEN conv_id % 5 = 2 THEN ' [' || repeat('987654321', 5) || '] [007]' ELSE '' END
         || ' [' || CAST(conv_id % 15 AS VARCHAR) || ']' AS answer
  FROM conversations WHERE role = 'assistant'),
b AS (SELECT conv_id, turn, answer, {bad_refs('answer', str(K))} AS bad FROM a)
SELECT conv_id, turn, array_to_string(bad, ', ') AS bad_refs, CAST(len(bad) AS BIGINT) AS n_bad,
       {annotate('answer', 'bad')} AS answer
FROM b"""
    o["grounding_check"] = f"""WITH {DOCS},
{CAT_CORPUS.strip()},
{CAT_Q.strip()},
{hybrid_topk('c', 'ccorpus', 'catq', K, 'hits').strip()}
SELECT (SELECT COUNT(*) FROM hits) AS n_hits,
       (SELECT COUNT(*) FROM hits WHERE doc_id IN (SELECT doc_id FROM served)) AS n_grounded,
       (SELECT COUNT(*) FROM hits WHERE doc_id NOT IN (SELECT doc_id FROM served)) AS n_missing"""
    o["retrieval_stats"] = f"""WITH {DOC_CORPUS.strip()},
{CONV_Q.strip()},
{hybrid_topk('d', 'dcorpus', 'convq', K, 'hits').strip()},
agg AS (SELECT question_id, COUNT(*) AS n_hits, MIN(score) AS min_score, MAX(score) AS max_score
        FROM hits GROUP BY question_id)
SELECT q.doc_id AS question_id, CAST(COALESCE(n_hits, 0) AS BIGINT) AS n_hits,
       COALESCE(min_score, {dbl(0.0)}) AS min_score, COALESCE(max_score, {dbl(0.0)}) AS max_score
FROM convq q LEFT JOIN agg ON agg.question_id = q.doc_id"""
    detail = "concat_ws(' · ', nullif(playlist_genre, ''), nullif(playlist_subgenre, ''))"
    listing = ("'  • ' || COALESCE(track_name, 'Unknown') || ' by ' || COALESCE(track_artist, 'Unknown') || "
               f"CASE WHEN {detail} <> '' THEN '  [' || {detail} || ']' ELSE '' END || "
               f"CASE WHEN score IS NOT NULL THEN '  ' || {fmt('score', 3)} ELSE '' END")
    o["hit_listing"] = f"WITH {catalogue_hits(CAT_Q)}\nSELECT question_id, rank, {listing} AS line FROM hd WHERE rank <= 5"

    def bar(c: str) -> str:
        pct = f"least({dbl(100.0)}, greatest({dbl(0.0)}, {c} * 100))"
        return f"CASE WHEN {c} IS NULL THEN '' ELSE printf('%.0f', {r1(pct, 0)}) || '%' END"

    def chip(c: str, unit: str) -> str:
        return (f"CASE WHEN {c} IS NULL THEN '' WHEN {c} = floor({c}) THEN CAST(CAST(floor({c}) AS BIGINT) AS VARCHAR) || {lit(unit)} "
                f"ELSE printf('%.1f', {r1(c, 1)}) || {lit(unit)} END")

    o["display_features"] = f"""WITH {catalogue_hits(CAT_Q)}
SELECT question_id, rank,
       CASE WHEN score IS NULL THEN '' ELSE printf('%.1f', {r1('score * 100', 1)}) || '% match' END AS score_label,
       {bar('energy')} AS energy_bar, {bar('danceability')} AS dance_bar, {bar('valence')} AS valence_bar,
       {bar('acousticness')} AS acoustic_bar, {chip('tempo', ' BPM')} AS tempo_chip,
       {chip('loudness', ' dB')} AS loudness_chip, {chip('track_popularity', '')} AS popularity_chip
FROM hd"""
    o["answer_questions"] = answers_sql()
    numbers = ", ".join(f"COALESCE({c}, {dbl(0.0)}) AS {c}" for c in fixed.RECORD_NUMBERS)
    o["result_records"] = f"""{answers_cte()}
SELECT question_id, rank, COALESCE(track_name, 'Unknown') AS track_name, COALESCE(track_artist, 'Unknown') AS track_artist,
       COALESCE(playlist_genre, '') AS playlist_genre, COALESCE(playlist_subgenre, '') AS playlist_subgenre, {numbers},
       score AS similarity_score
FROM hd"""
    # the stream must give exactly the batch answers
    o["stream_questions"] = answers_sql()
    cited = f"'[1] for ' || CAST(length(v.question) AS VARCHAR) || ' characters'"
    o["stream_retries"] = f"""{answers_cte()}
SELECT v.doc_id AS question_id,
       CASE WHEN a.question_id IS NULL THEN {lit(fixed.NO_HITS_ANSWER)} WHEN NOT contains(v.question, 'ring') THEN {cited} END AS answer,
       CASE WHEN a.question_id IS NOT NULL AND contains(v.question, 'ring') THEN 'ValueError: no answer' END AS reason,
       CASE WHEN a.question_id IS NULL OR NOT contains(v.question, 'ring') THEN 1 END AS attempt
FROM valid v LEFT JOIN agg a ON a.question_id = v.doc_id
UNION ALL SELECT doc_id, NULL, {lit(fixed.EMPTY_QUESTION)}, NULL FROM vq WHERE question IS NULL OR length(question) = 0"""
    return {k: _q(v) for k, v in o.items()}


ORACLES = _build()
