"""Constants of the engine, by the operator that uses them."""

from __future__ import annotations

BM25_K1, BM25_B, LEXICAL_TOP = 1.2, 0.75, 50
RRF_K, FUSED_TOP = 60, 50
FRESH_DAYS = 30
PROPENSITY_JITTER = 0.05
DECAY = {"fact": 0.15, "episodic": 0.35, "ambient": 0.6}
PREDICATE_COSINE = 0.85
DAMPING_DAYS, DAMPING_LOW, DAMPING_HIGH = 14, 0.5, 1.5
# What a signal adds to the damping coefficient; engagements are shares of 0.05.
DAMPING = {"surfacing": -0.02, "direct": 0.05, "paraphrase": 0.05 * 0.7, "correction": 0.05 * 1.2, "dismiss": 0.05 * -0.5, "no_engagement": 0.0, "inherited": 0.05 * 0.5}
FEEDBACK = {"surfaced": 0.0, "opened": 0.5, "replied": 1.0, "dismissed": -0.5, "flagged_spam": -1.0}
FEEDBACK_STEEPNESS = 0.6
ENGAGE_FULL_DAYS, ENGAGE_FLOOR_DAYS, ENGAGE_FLOOR = 30, 60, 0.25
THREAD_MIN, THREAD_KEEP, THREAD_CHARS = 3, 16, 500
BRIEF_ITEMS, BRIEF_CHARS, BRIEF_ITEM_CHARS = 12, 4000, 600
RETAIN_CAP = 2000
EXCISE_HOPS, EXCISE_FLOOR = 3, 0.01
SET_WIDTH, SET_BITS, SET_LINKS, PAIRS_TASK = 13, 1 << 28, 1 << 19, 4_000_000
TOPIC_TOP, TOPIC_FILLER_DF = 12, 0.8

# Words that the lexical index leaves out.
STOP_WORDS = (
    "a an and are as at be but by for from had has have he her his i if in into is it its itself me my no not of off on or our "
    "she so that the their them then there they this to too was we were what when where which who will with would you your yours"
).split()

SIGN_THRESHOLD, LEAST_TOKENS = 0.05, 2
EPISODIC = {"base": -1.5, "anchor": 1.2, "corroboration": 0.4, "generality": -0.7, "valence": 0.3}
CONSENT = {"blocked": 0.0, "third_party_inferred": 0.6}
ORPHAN_FIRST, ORPHAN_FLOOR, ORPHAN_RATE = 0.5, 0.05, 0.4
PREDICATES_MAX = 1024
DIRECTED_WEIGHTS = {"addressed": 0.5, "reply": 0.3, "mention": 0.2}
DIRECTED_SHIFT, DIRECTED_DM, DIRECTED_AT = 0.6, 0.5, 0.5
MENTION_UNSURE, MENTION_LOOSE = 0.4, 0.7
MMR_LAMBDA, MMR_INPUT, MMR_OUTPUT = 0.7, 15, 12
DENSE_SHARE, DENSE_COUNT, SPARSE_COUNT = 0.05, 60, 3
PROPENSITY_TAU = 0.3
SALIENCE = {"recency": 0.15, "authorship": 0.20, "content_mass": 0.15, "source_prior": 0.10, "structural": 0.15, "novelty": 0.25}
DRIFT_POINTS = 0.05
EVAL_K, CI_RESAMPLES, CI_LEVEL = 12, 10_000, 0.90
GRID_ENGAGEMENT, GRID_DAMPING = (0.0, 0.01, 0.02, 0.04), (0.0, 0.01, 0.02, 0.03)
PROJECT_MIN, PROJECT_KEEP, PROJECT_CHARS = 2, 16, 500

# Words of the valence lexicon, and those it leaves out of the length.
POSITIVE_WORDS = (
    "love loved loves loving adore adored excited exciting happy joy joyful delighted delight thrilled ecstatic elated glad "
    "great amazing awesome fantastic wonderful excellent brilliant perfect superb incredible outstanding good nice lovely "
    "beautiful fabulous fab thanks thank grateful appreciate appreciated yes yeah yep yay woohoo win won winning success "
    "successful succeeded celebrate celebrating enjoy enjoyed enjoying fun cool pleased pleasant smile smiling laugh laughing lol"
).split()
NEGATIVE_WORDS = (
    "hate hated hates hating loathe despise disgusted dislike disliked angry furious mad rage enraged pissed annoyed annoying "
    "irritated irritating frustrated frustrating frustration sad sadness depressed depressing miserable unhappy upset cry crying "
    "tears grief lonely afraid scared fear fearful worried worry anxious anxiety panic nervous stressed stress wrong bad terrible "
    "horrible awful worst worse broken fail failed failure failing stupid dumb useless pointless hopeless ugly pain painful hurt "
    "hurts hurting sick tired exhausted sucks sucked suck"
).split()
NEUTRAL_WORDS = (
    "the a an of to in on at for is are was were be been being do does did and or but this that these those it its i you he she "
    "we they me him her us them my your his our their"
).split()
# Valence of a mood.
MOODS = {
    "frustrated": -0.7, "angry": -0.8, "furious": -0.9, "sad": -0.6, "upset": -0.6, "anxious": -0.7, "worried": -0.6,
    "stressed": -0.7, "exhausted": -0.5, "tired": -0.4, "excited": 0.7, "happy": 0.7, "joyful": 0.8, "grateful": 0.6,
    "proud": 0.6, "calm": 0.4, "neutral": 0.0, "focused": 0.0, "thinking": 0.0,
}
RECALL_WEIGHTS = {"entity": 0.7, "time": 1.5, "decay": 0.3, "valence": 0.2}
RECALL_FLOOR, RECENT_FACTOR = 0.10, 0.25
NOVELTY_LERP, CORROBORATE_INDEX = 200, 50

# Priors, half-lives in days and corroboration distances by source.
SOURCE_PRIOR = {"git-log": 0.85, "chat": 0.70, "codex-cli": 0.70, "imessage": 0.60, "telegram": 0.60, "slack": 0.60, "github-events": 0.55, "mail": 0.55, "screentime": 0.20}
TAU_DAYS = {"imessage": 90.0, "telegram": 90.0, "slack": 90.0, "screentime": 30.0, "git-log": 365.0, "github-events": 180.0, "mail": 180.0, "chat": 60.0, "codex-cli": 60.0}
CORROBORATE_DISTANCE = {"imessage": 0.18, "telegram": 0.18, "slack": 0.18, "git-log": 0.28, "github-events": 0.30, "screentime": 0.35, "chat": 0.25, "codex-cli": 0.25, "mail": 0.25}

OPPOSED_OVERLAP, OPPOSED_VALENCE, OPPOSED_COSINE = 0.3, 0.4, -0.05
AUTHORITY_LEAST, SUBSTITUTE_GAIN, SIBLINGS_MAX = 0.85, 0.2, 32
ENGAGEMENT = {"direct": 1.0, "paraphrase": 0.6, "correction": 0.4, "dismiss": -0.5, "no_engagement": 0.0}
ENGAGED_RUN, ENGAGED_BAG, NEGATION_REACH = 3, 0.75, 6
GATE_LABELS, GATE_NDCG, GATE_HARM, GATE_WEEKLY, GATE_WEEKS, VOLUME_WEEKS = 150, 0.03, 0.0, 200, 8, 4
RECENT_DAYS, RECENT_FLOOR, CADENCE_RECENT, CADENCE_DORMANT = 7, 0.05, 0.66, 0.06
TIER_RECIPROCITY, EARLIEST_SECOND = 0.9, 1_199_145_600

# Words that deny, and phrases that dismiss.
NEGATIONS = "no not wrong actually but incorrect nope false".split()
DISMISSALS = r"(?i)\b(stop\s+bringing|not\s+relevant|irrelevant|forget\s+(that|it)|drop\s+(it|that)|don't\s+(care|mention))\b"

HEALTH_DAYS, FUNNEL_ROWS, STALE_HOURS, HOSTNAME_SHARE = 30, 100, 6, 0.05
LAG_WARN_MS, LAG_GROWTH_MS = 24 * 3_600_000, 3_600_000
LIVE_ROWS, LIVE_SHARE = 100, 0.5
GAINS = {"expected": 2.0, "neighbour": 1.0, "forbidden": -2.0}
CATCHUP_ROWS, CATCHUP_MOST = 50, 500

# The inverted index: buckets of terms, tasks that write a bucket, and the share of texts that it must cover to serve.
POSTING_BUCKETS, POSTING_SPLITS, LEXICAL_COVERAGE = 64, 4, 0.99
HITS_TASK, ASKED_TASK = 2_000_000, 500_000
# The vector index: rows a cell, rows that the centroids are trained on, rounds, cells probed first, and rows and queries that meet at once.
CELL_ROWS, CELL_SAMPLE, CELLS_MOST, CELL_ROUNDS, PROBES = 256, 20_000, 4_096, 8, 8
BLOCK_ROWS, BLOCK_QUERIES = 16_384, 2_048

# Kinds of entities, and the least code points of a name.
ENTITY_KINDS, NAME_LEAST = ("person", "place", "org", "project", "event", "topic", "artifact"), 3
#: Different numbers of pieces that the names of a lexicon may have.
NAME_PIECES = 32
NAME_BITS, NAME_TABLE = 32, 28

# Days that the health state keeps, the last days of a report, and the share of entities a fact that may go.
HEALTH_KEPT, HEALTH_RECENT, ENTITY_DROP = 32, 7, 0.10
#: Numbers in a list from which on it is a vector, which isn't shown.
VECTOR_LEAST = 64
