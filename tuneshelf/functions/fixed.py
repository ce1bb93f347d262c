"""Fixed values.

Everything in this module is a value that must stay equal to the behaviour being
reproduced (word lists, labels, thresholds, sentence templates, prompt texts).
They are stated plainly, in natural order, in one place.  No logic lives here.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES: retrieval settings
# ---------------------------------------------------------------------------
TOP_K = 12                 # hits per question
BATCH_TOP_K = 5            # hits per profile in batch mode
SEMANTIC_OVERFETCH = 2     # nearest (2 * k) before the track filter
VOCAB_SIZE = 5000          # TF-IDF vocabulary cap (1- and 2-grams)
WEIGHT_COSINE = 0.7        # hybrid score: 0.7 * cosine + 0.3 * popularity / 100
WEIGHT_POPULARITY = 0.3
EMBED_BATCH = 500          # documents per embedding batch
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"   # word runs of two or more characters

# ---------------------------------------------------------------------------
# FIXED VALUES: routing signal words (substring match on the lowercased question)
# ---------------------------------------------------------------------------
ROUTING_SIGNALS = ["popular", "top", "best", "trending", "most played", "chart"]

# ---------------------------------------------------------------------------
# FIXED VALUES: bucket thresholds and labels
# ---------------------------------------------------------------------------
ENERGY_HIGH, ENERGY_MID = 0.7, 0.4
ENERGY_LABELS = ["high-energy", "mid-energy", "low-energy"]
VALENCE_HIGH, VALENCE_MID = 0.6, 0.4
TRACK_MOOD_LABELS = ["happy and upbeat", "emotionally neutral", "melancholic or intense"]
ARTIST_MOOD_LABELS = ["upbeat", "mixed", "dark/melancholic"]

# ---------------------------------------------------------------------------
# FIXED VALUES: text used for missing data
# ---------------------------------------------------------------------------
MISSING_NUMBER = "N/A"     # missing numeric in a blurb
MISSING_CELL = "nan"       # missing string cell rendered in text
NA_STRINGS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# ---------------------------------------------------------------------------
# FIXED VALUES: prompt and response texts
# ---------------------------------------------------------------------------
SYSTEM_PROMPT = """You are a music recommender assistant.
You will receive a numbered catalog of tracks retrieved from a music database.
Your job is to recommend the best matching tracks from this catalog for the user's request.

Rules:
- ALWAYS recommend tracks — pick the closest matches even if the fit is imperfect.
- Never refuse or say you cannot find matches. Instead, recommend the best available
  tracks and briefly note how they relate to (or differ from) the request.
- Reference each recommendation by catalog number, track name, and artist.
- Format each recommendation as: [N] "Track Name" by Artist Name — one-line reason.
- Do not invent or hallucinate tracks outside the provided catalog.
- Begin with one short paragraph explaining your rationale and any caveats about fit."""
PROMPT_HEADER = "RETRIEVED TRACK CATALOG ({n} tracks):"
PROMPT_REQUEST = "USER REQUEST: "
PROMPT_INSTRUCTION = (
    "Recommend the best matching tracks from the catalog above. "
    "Always provide recommendations — note any fit caveats rather than refusing."
)
NO_HITS_ANSWER = "I couldn't find any tracks in the catalog for that query."
BAD_REFS_NOTE = "\n\n⚠️ Note: Response referenced catalog entries [{refs}] which are outside the retrieved set."
RECORD_NUMBERS = ["track_popularity", "energy", "danceability", "valence", "tempo", "loudness"]
NO_RESULTS_LINE = "No results found."
EMPTY_QUESTION = "Question must not be empty."

# ---------------------------------------------------------------------------
# FIXED VALUES: sample questions (suggestion list, then the CLI examples)
# ---------------------------------------------------------------------------
SAMPLE_QUESTIONS = [
    "High-energy workout tracks",
    "Sad, acoustic songs for a rainy day",
    "Upbeat pop songs to dance to",
    "Chill instrumental background music",
    "Fast tempo hip-hop tracks",
    "Happy songs with high valence",
    "Lo-fi tracks with low speechiness",
    "Classic rock with high energy",
    "I want something chill and acoustic for studying",
    "Recommend high-energy electronic tracks",
    "What should I listen to if I like jazz but want something upbeat?",
]

# ---------------------------------------------------------------------------
# FIXED VALUES: built-in batch profiles (label, genre, valence, energy)
# ---------------------------------------------------------------------------
BUILTIN_PROFILES = [
    ("High-Energy Pop", "pop", 0.8, 0.9),
    ("Chill Lofi", "lofi", 0.5, 0.35),
    ("Deep Intense Rock", "rock", 0.4, 0.95),
    ("Conflicting: High-Energy but Chill Mood", "electronic", 0.5, 0.95),
    ("Ghost Genre (country)", "country", 0.8, 0.7),
    ("Floor Energy", "electronic", 0.6, 0.9),
]

# ---------------------------------------------------------------------------
# FIXED VALUES: English stop words (318), removed before n-grams
# ---------------------------------------------------------------------------
STOP_WORDS = """
a about above across after afterwards again against all almost alone along already also although
always am among amongst amoungst amount an and another any anyhow anyone anything anyway anywhere
are around as at back be became because become becomes becoming been before beforehand behind
being below beside besides between beyond bill both bottom but by call can cannot cant co con
could couldnt cry de describe detail do done down due during each eg eight either eleven else
elsewhere empty enough etc even ever every everyone everything everywhere except few fifteen
fifty fill find fire first five for former formerly forty found four from front full further
get give go had has hasnt have he hence her here hereafter hereby herein hereupon hers herself
him himself his how however hundred i ie if in inc indeed interest into is it its itself keep
last latter latterly least less ltd made many may me meanwhile might mill mine more moreover
most mostly move much must my myself name namely neither never nevertheless next nine no nobody
none noone nor not nothing now nowhere of off often on once one only onto or other others
otherwise our ours ourselves out over own part per perhaps please put rather re same see seem
seemed seeming seems serious several she should show side since sincere six sixty so some
somehow someone something sometime sometimes somewhere still such system take ten than that
the their them themselves then thence there thereafter thereby therefore therein thereupon
these they thick thin third this those though three through throughout thru thus to together
too top toward towards twelve twenty two un under until up upon us very via was we well were
what whatever when whence whenever where whereafter whereas whereby wherein whereupon wherever
whether which while whither who whoever whole whom whose why will with within without would
yet you your yours yourself yourselves
""".split()

# ---------------------------------------------------------------------------
# FIXED VALUES: sentence templates ({name} marks a column)
# ---------------------------------------------------------------------------
TRACK_BLURB = (
    "{track_name} by {track_artist} is a {energy_desc} {playlist_genre} track "
    "({playlist_subgenre}) from the album '{track_album_name}' released on {track_album_release_date}. "
    "It has a danceability of {danceability}, tempo of {tempo} BPM, loudness of {loudness} dB, "
    "acousticness of {acousticness}, instrumentalness of {instrumentalness}, liveness of {liveness}, "
    "speechiness of {speechiness}, and valence of {valence} ({mood}). "
    "Popularity score: {track_popularity}."
)
TRACK_BLURB_DEFAULTS = {
    "track_name": "Unknown", "track_artist": "Unknown", "playlist_genre": "",
    "playlist_subgenre": "", "track_album_name": "Unknown", "track_album_release_date": "unknown date",
}
ARTIST_BLURB = (
    "{artist} appears {n_tracks} time(s) in this dataset. "
    "Their music spans genres: {genres}. "
    "Subgenres include: {subgenres}. "
    "On average their tracks have energy {energy}, danceability {danceability}, "
    "valence {valence} ({mood}), and tempo {tempo} BPM."
)
ARTIST_DOC_PREFIX = "artist__"
TRACK_DOC_PREFIX = "track_"
CATALOG_ENTRY = (
    "[{rank}] \"{track_name}\" by {track_artist}\n"
    "    Genre: {playlist_genre} / {playlist_subgenre} | Energy: {energy} | "
    "Tempo: {tempo} BPM | Similarity: {score}\n"
    "    {blurb}"
)
BATCH_LINE = "#{rank}  {track_name} by {track_artist} [{playlist_genre}]  score={score}  energy={energy}"
PROFILE_QUESTION = "{genre} music with energy {energy} and valence {valence}"
REASON_GENRE = "genre match ({genre}, +1.0)"
REASON_MOOD = "mood match ({mood}, +1.0)"
REASON_ENERGY = "energy similarity {sim} (song={song_energy}, target={target_energy})"
EXPLAIN_GENRE = "genre match ({genre}, +2.0)"
EXPLAIN_MOOD = "mood match ({mood}, +1.0)"
EXPLAIN_ENERGY = "energy similarity {sim} (song={song_energy}, target={target_energy})"
PROFILE_DEFAULTS = {"genre": "", "mood": "", "energy": 0.5}
STUB_ANSWER_LINE = "[{rank}] \"{track_name}\" by {track_artist} — closest match in the catalog."

# ---------------------------------------------------------------------------
# FIXED VALUES: reserved catalogue column and its new name
# ---------------------------------------------------------------------------
RESERVED_COLUMN = "type"
RESERVED_COLUMN_RENAMED = "spotify_type"
