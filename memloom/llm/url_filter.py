"""URL verdicts: host rules first, then naive Bayes over segmented words.

Host labels are often words run together. A unigram model of words (from the running
text of the pages, and the labelled examples) splits them by Viterbi, and a
multinomial naive Bayes model scores the words of host and path. A word counts by the sites whose text has it, so
neither a name nor the number of its pages makes it a word. All counts stay in
a table: each distinct name is joined to those of its substrings, and split once.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, written

# Labelled examples for the naive Bayes model where the caller has none: words by the topics of public category lists.
# One topic is one example; nothing here is taken from the tables.
BLOCK_TOPICS = {
    "adult": "adult porn porno xxx sex sexy nude erotic escort cams webcam girls hot dating hookup fetish tube",
    "gambling": "casino poker roulette slots slot jackpot bingo lottery lotto bet bets betting wager odds bookmaker gamble gambling win winner spins bonus",
    "pharmacy": "pills pill pharma pharmacy meds drugs viagra cialis tablets prescription diet slimming steroids cheap discount",
    "money": "loan loans payday cash credit debt rich profit forex crypto bitcoin doubler giveaway invest easy quick fast",
    "fakes": "replica fake knockoff counterfeit outlet handbags watches sale cheap free",
    "malware": "malware virus trojan crack cracked keygen warez serial hack hacked exploit torrent phish phishing login verify",
    "tracking": "ads ad adserver advert banner banners popup popunder track tracker tracking pixel click clicks beacon analytics affiliate promo",
    "spam": "spam spammer bulk farm linkfarm backlinks seo traffic bot bots clickbait viral prize prizes claim gift free win",
}
ALLOW_TOPICS = {
    "press": "news daily post times press journal herald tribune gazette chronicle magazine newspaper editorial weekly report",
    "learning": "school university college academy education course courses lessons student students teacher language grammar study",
    "science": "science research lab physics biology chemistry math data institute papers journal space climate",
    "culture": "library museum gallery art arts history book books poetry theatre film music review reviews heritage archive",
    "home": "cooking recipes recipe kitchen garden family home travel guide food health care hospital clinic medical",
    "public": "city council government gov office public tax ministry court police park map train bus weather",
    "software": "docs code open source software developer forum wiki help support manual linux python web standards",
    "sport": "sports football club chess league team tennis cycling running",
}

#: Letters of a word at most; a longer run of letters is split, or taken as unknown.
MAX_WORD = 24
#: Sites whose text must have a word, and letters of the parts that a name which is itself a word is split into.
LEAST_SITES, PART = 2, 3
#: Share of urls to block that the verdict assumes: one word of a topic to block outweighs it, if no other word speaks against.
PRIOR_BLOCK = 0.4
#: Scores are summed as whole numbers of this size, so that no order of rows matters.
UNIT = 1 << 32
_TOKEN = "[^a-z0-9\\x80-\\x{10ffff}]+"


def ascii_lower(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for null and for text without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, "^([^/?#]*)", 1))
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_column(rules: dict[str, str], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, of equal ones that with the longer host; null if none does."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), len(r.split("/", 1)[0]))):
        name, slash, rest = rule.partition("/")
        fits = (host == name) | host.endswith(f".{name}")
        if slash:
            fits &= path.startswith(f"/{rest}")
        found = F.when(fits, F.lit(rule)).otherwise(found)
        verdict = F.when(fits, F.lit(rules[rule])).otherwise(verdict)
    return found, verdict


def topic_examples() -> tuple[list[str], list[str]]:
    """The texts of the built-in examples to block and to allow."""
    return list(BLOCK_TOPICS.values()), list(ALLOW_TOPICS.values())


def example_words(texts: list[str]) -> list[list[str]]:
    return [re.findall(r"[a-z0-9]+", t) for t in texts]


def unigram_counts(texts: DataFrame) -> DataFrame:
    """(token, n) of ``site, html``: on how many sites' pages a word stands, at least LEAST_SITES.

    Words are what stands between white space, without marks at its end, in text without tags, scripts and styles; what holds
    dots or slashes, like the name of a host, is no word. A site counts once however many pages it has.
    """
    bare = F.regexp_replace(F.col("html"), r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    words = F.transform(F.split(ascii_lower(bare), r"\s+"), lambda w: F.regexp_replace(w, "[.,;:!?]+$", ""))
    shaped = F.array_distinct(F.filter(words, lambda w: w.rlike(rf"^[a-z0-9\x80-\x{{10ffff}}]{{2,{MAX_WORD}}}$")))
    return texts.select("site", F.explode(shaped).alias("token")).distinct().groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_SITES)


def site(host: Column) -> Column:
    """The last two labels of a host."""
    return F.regexp_extract(host, r"([^.]*\.)?[^.]*$", 0)


class Segmenter:
    """Unigram Viterbi: the split of a name with the highest product of word probabilities.

    A word that the model lacks costs as one of a probability that falls tenfold per letter. A name that is itself a word, but
    none of the examples, is split all the same if it is made of known words of PART letters or more: so it doesn't
    matter whether some text has it. ``more`` is the weight of the words that ``split`` is given with each name.
    """

    def __init__(self, counts: dict[str, int], seeds: set[str], more: float = 0.0):
        weight = {w: math.log1p(n) + (4 if w in seeds else 0) for w, n in counts.items()}
        self.seeds = seeds
        self.total = math.log(math.fsum(weight.values()) + more or 1)
        self.cost = {w: self.total - math.log(v) for w, v in weight.items()}
        self.unknown = self.total + 1

    def _best(self, name: str, cost: dict[str, float], unknown: bool, whole: bool) -> tuple[float, tuple[str, ...]]:
        best, back = [0.0], [0]
        for end in range(1, len(name) + 1):
            found = (math.inf, 0)
            for start in range(max(0, end - MAX_WORD), end):
                word = name[start:end]
                known = cost.get(word, math.inf) if whole or PART <= len(word) < len(name) else math.inf
                found = min(found, (best[start] + (min(known, self.unknown + math.log(10) * len(word)) if unknown and known == math.inf else known), start))
            best.append(found[0])
            back.append(found[1])
        words, end = [], len(name)
        while end and best[-1] < math.inf:
            words.append(name[back[end] : end])
            end = back[end]
        return best[-1], tuple(reversed(words))

    def split(self, name: str, counts: dict[str, int] | None = None) -> tuple[str, ...]:
        """The words of the whole name; ``counts`` has those of its substrings that this model lacks."""
        cost = self.cost | {w: self.total - math.log(math.log1p(n)) for w, n in (counts or {}).items() if w not in self.cost}
        _, words = self._best(name, cost, True, True)
        if len(words) == 1 and name not in self.seeds:
            price, parts = self._best(name, cost, False, False)
            words = parts if price < math.inf else words
        return words


class NaiveBayes:
    """Multinomial, with add-one smoothing; words that no class has seen say nothing."""

    def __init__(self, block: list[list[str]], allow: list[list[str]], prior_block: float = PRIOR_BLOCK):
        vocabulary = {w for words in [*block, *allow] for w in words}
        self.prior = math.log(prior_block / (1 - prior_block))
        tallies = []
        for examples in (block, allow):
            count: dict[str, int] = {}
            for words in examples:
                for w in words:
                    count[w] = count.get(w, 0) + 1
            tallies.append((count, sum(count.values()) + len(vocabulary)))
        (b, nb), (a, na) = tallies
        self.weight = {w: math.log((b.get(w, 0) + 1) / nb) - math.log((a.get(w, 0) + 1) / na) for w in vocabulary}

    def score(self, words) -> float:
        """Log odds of block."""
        return self.prior + sum(self.weight.get(w, 0.0) for w in words)

    def units(self, words) -> int:
        """What the words add to the log odds, in UNITs."""
        return sum(round(self.weight.get(w, 0.0) * UNIT) for w in words)


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_names(host: str, path: str) -> list[str]:
    return [t for t in re.split(r"[^a-z0-9\x80-\U0010ffff]+", f"{host}/{path.translate(_LOWER)}") if t]


def _named(batches):
    """(host, path, name) for each name of a url."""
    import pyarrow as pa

    for batch in slices(batches, 2 << 20):
        rows = [(h, p, t) for h, p in zip(*(c.to_pylist() for c in batch.columns), strict=True) for t in url_names(h, p)]
        yield pa.record_batch([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], ["host", "path", "name"])


def _substrings(batches):
    """(key, token) for each distinct substring of a name that may be a word."""
    import pyarrow as pa

    def made(rows):
        return pa.record_batch([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["key", "token"])

    for batch in batches:
        rows: list[tuple[bytes, str]] = []
        for key, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows += [(key, t) for t in {name[i : i + k] for i in range(len(name)) for k in range(2, min(MAX_WORD, len(name) - i) + 1)}]
            if len(rows) > 100_000:
                yield made(rows)
                rows = []
        yield made(rows)


def name_scores(names: DataFrame, counts: DataFrame, block: list[list[str]], allow: list[list[str]]) -> DataFrame:
    """(name, score) of distinct names: the naive Bayes weight of their words, in UNITs."""
    seeds = [w for words in [*block, *allow] for w in words]
    known = F.col("token").isin(sorted(set(seeds)))
    fixed = {r["token"]: r["n"] for r in counts.where(known).collect()}
    for w in seeds:
        fixed[w] = fixed.get(w, 0) + 5
    # A sum of whole numbers is the same in any order.
    whole = counts.where(~known).agg(F.sum(F.round(F.log1p("n") * UNIT).cast("decimal(38,0)")).alias("s")).first()["s"]
    more = float(whole or 0) / UNIT

    def score(batches):
        import pyarrow as pa

        segmenter, bayes = Segmenter(fixed, set(seeds), more), NaiveBayes(block, allow)
        now, name, found = None, None, {}
        for batch in batches:
            done = []
            for key, text, token, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    if now is not None:
                        done.append((name, bayes.units(segmenter.split(name, found))))
                    now, name, found = key, text, {}
                else:
                    found[token] = n
            yield pa.record_batch([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["name", "score"])
        if now is not None:
            yield pa.record_batch([pa.array([name], pa.string()), pa.array([bayes.units(segmenter.split(name, found))], pa.int64())], ["name", "score"])

    keyed = names.select(F.unhex(F.sha2("name", 256)).alias("key"), "name")
    found = keyed.mapInArrow(_substrings, "key binary, token string").join(counts.where(~known), "token")
    # The name's own row has no token and comes first.
    rows = keyed.select("key", "name", F.lit(None).cast("string").alias("token"), F.lit(None).cast("long").alias("n"))
    rows = rows.unionByName(found.select("key", F.lit(None).cast("string").alias("name"), "token", "n"))
    return rows.repartition("key").sortWithinPartitions("key", F.col("token").asc_nulls_first()).mapInArrow(score, "name string, score long")


def filter_urls(
    pages: DataFrame,
    rules: dict[str, str],
    id_col: str = "page_id",
    url_col: str = "url",
    examples: tuple[list[str], list[str]] | None = None,
    prior_block: float = PRIOR_BLOCK,
    text_col: str = "html",
) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict (allow or block).

    Rules are ``host/path`` prefixes with their verdict, a short list that becomes one CASE. A url
    that no rule fits goes to the method, and without host and path it is allowed by the prior.
    ``examples`` are texts to block and to allow, which the model learns from (a bounded list; by
    default the built-in topics). Words of the segmenter come from the pages' ``text_col``, where there is one. Names are
    taken whole, however long. Repeated rows are judged alike, and so is a url however often it or its host occurs; null ids stay, null urls have empty parts, other columns are ignored, no rows give none.
    """
    block, allow = (example_words(t) for t in examples or topic_examples())
    url = F.col("url")
    html = F.col(text_col).cast("string") if text_col in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    host, path = split_url(url)
    texts = rows.select(site(host).alias("site"), "html")
    parts = rows.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_column(rules, F.col("host"), F.col("path"))
    ruled = parts.withColumns({"rule": rule, "ruled": verdict})
    counts = written(unigram_counts(texts), "url-counts")
    open_urls = ruled.where("ruled is null").select("host", "path").distinct()
    named = written(open_urls.mapInArrow(_named, "host string, path string, name string"), "url-names")
    scores = written(name_scores(named.select("name").distinct(), counts, block, allow), "name-scores")
    prior = round(NaiveBayes(block, allow, prior_block).prior * UNIT)
    judged = named.join(scores, "name").groupBy("host", "path").agg((F.sum("score") + F.lit(prior) > 0).alias("blocked"))
    made = ruled.join(judged, ["host", "path"], "left")
    verdict = F.coalesce("ruled", F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow")))
    return made.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
