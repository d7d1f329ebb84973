"""Role-aware reader: posts to readings of hazards and the places they affect, in expressions only.

A post becomes a table of words, dealt by post once; everything after that is a
window over words of a post, of a sentence, of a clause. ``marked_words`` has
what depends on a word and its neighbours, ``placed_words`` adds places and the
roles of list items, ``clauses`` adds up what each clause says and carries kinds
forward, and ``read`` gives the readings.

Roles. A word takes the strongest cue of the run of cues and fillers right before
it. Items (places, and capitalised words that no vocabulary knows) that only
conjunctions part form a list, which the first item's cue opens. A target or
via list holds for all its items, an origin for the places before the first
unknown word; all other places are mentions, and all other unknown words nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..params import MAX_TEXT_CHARS
from .vocabulary import READER_KINDS, SOURCE_WORDS, Lexicon, RoleGazetteer, Words

ROLES = ("mention", "origin", "via", "target")
MAX_COUNT = 100
#: Letters by which words and place patterns meet, and most patterns that are sent to all tasks.
KEY_LETTERS, MAX_BROADCAST = 3, 100_000
#: Characters of posts whose words are one task's work: its sorts and windows hold some 300 times as many bytes.
TASK_CHARS = 1_500_000
META = ("source_id", "external_id", "published_at", "url", "forwarded")


def _in(word: Column, words: Words) -> Column:
    """Whether a word is one of ``words``; false for none."""
    return F.coalesce(words.column(word), F.lit(False)) if words.forms or words.stems else F.lit(False)


def _first_of(named: list[tuple[str, Column]]) -> Column:
    """The name of the first condition that holds."""
    return F.coalesce(*(F.when(holds, name) for name, holds in named)) if named else F.lit(None).cast("string")


def kind_of(word: Column, source: Column, lexicon: Lexicon) -> Column:
    """The first kind in vocabulary order, or what the source's own shorthand stands for."""
    own = [(kind, (word == short) & (source == name)) for (name, short), kind in SOURCE_WORDS.items()]
    return _first_of([(kind, _in(word, words)) for kind, words in lexicon.kinds.items()] + own)


def _number(word: Column) -> Column:
    """Digits or a number word; 0 stands for digits beyond an int."""
    return F.coalesce(T.number_word(word), F.when(word.rlike("^[0-9]+$"), F.lit(0)))


def _dealt(parts: DataFrame, posts: DataFrame) -> DataFrame:
    """Words dealt by post, to as many tasks as the texts need, so that a task's memory doesn't grow with the input."""
    if posts.isStreaming:
        return parts
    chars = posts.agg(F.sum(F.length("text"))).first()[0] or 0
    return parts.repartition(max(parts.sparkSession.sparkContext.defaultParallelism, -(-chars // TASK_CHARS)), "post")


def split_words(evidence: DataFrame, max_chars: int = MAX_TEXT_CHARS) -> DataFrame:
    """``post, pos, text, plain, sentence, after_comma`` and ``META`` of every word of posts with a text of at most ``max_chars``.

    ``post`` numbers rows of the input; the same input gives the same numbers to a task that runs again.
    """
    posts = evidence.filter(F.col("text").isNotNull() & (F.length("text") <= max_chars)).select(
        F.monotonically_increasing_id().alias("post"), "source_id", "external_id", "published_at", F.col("provenance.url").alias("url"), F.col("forwarded_from").isNotNull().alias("forwarded"), "text"
    )
    parts = _dealt(posts.select("post", *META, F.posexplode(T.role_parts("text")).alias("at", "part")), posts)
    so_far = Window.partitionBy("post").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    counted = parts.withColumn("sentence", F.count_if(F.col("part").rlike(f"^{T.ROLE_BREAK}$")).over(so_far)).withColumn("commas", F.count_if(F.col("part") == ",").over(so_far)).filter(T.is_word("part"))
    of_sentence = Window.partitionBy("post", "sentence").orderBy("at")
    return counted.select(
        "post", *META, F.row_number().over(Window.partitionBy("post").orderBy("at")).alias("pos"), F.col("part").alias("text"), T.fold("part").alias("plain"), "sentence",
        F.coalesce(F.col("commas") > F.lag("commas").over(of_sentence), F.lit(False)).alias("after_comma"),
    )


def _clears(lexicon: Lexicon, within: Window) -> Column:
    """An all-clear word that no negator right before, and none of two words after, takes back."""
    near = lambda by, where: ~F.coalesce(_in(where.over(within), by), F.lit(False))
    return _in(F.col("plain"), lexicon.cleared) & near(lexicon.negated_by, F.lag("plain")) & near(lexicon.negated_after, F.lead("plain")) & near(lexicon.negated_after, F.lead("plain", 2))


def marked_words(words: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Adds ``clause, kind, clears, hit, count, cue, before_cue, joins, fills``.

    In a sentence with an all-clear, a comma begins a clause if what follows it up
    to the next comma names a hazard. Neighbours are then looked at again, in clauses.
    """
    sentence = Window.partitionBy("post", "sentence").orderBy("pos")
    segment = Window.partitionBy("post", "sentence", "segment")
    cue = _first_of([(role, _in(F.col("plain"), lexicon.cues[role])) for role in ("target", "via", "origin") if role in lexicon.cues])
    known = words.withColumns({
        "kind": kind_of(F.col("plain"), F.col("source_id"), lexicon), "cue": cue, "joins": _in(F.col("plain"), lexicon.conjunctions), "fills": _in(F.col("plain"), lexicon.fillers),
        "says_clear": _clears(lexicon, sentence), "segment": F.count_if("after_comma").over(sentence), "opens": F.row_number().over(sentence) == 1,
    })
    whole = Window.partitionBy("post", "sentence")
    cut = known.withColumn("cuts", F.col("after_comma") & F.max("says_clear").over(whole) & (F.count("kind").over(segment) > 0))
    claused = cut.withColumn("clause", F.count_if(F.col("opens") | F.col("cuts")).over(Window.partitionBy("post").orderBy("pos")))
    clause = Window.partitionBy("post", "clause").orderBy("pos")
    one, two = F.lag("plain").over(clause), F.lag("plain", 2).over(clause)
    counts = lambda number, unit: F.when(number.between(1, MAX_COUNT) & ~unit.isin(*sorted(T.UNITS)), number)
    near = F.when(_number(one).isNotNull(), counts(_number(one), F.col("plain"))).otherwise(counts(_number(two), one))
    runs = claused.withColumns({
        "clears": _clears(lexicon, clause), "hit": _in(F.col("plain"), lexicon.intercepted) & ~F.coalesce(_in(one, lexicon.intercepted_negated_by), F.lit(False)), "count": F.when(F.col("kind").isNotNull(), near),
        "run": F.count_if(F.col("cue").isNull() & ~F.col("fills")).over(clause.rowsBetween(Window.unboundedPreceding, -1)),
    })
    rank = F.array_position(F.array(*map(F.lit, ROLES)), F.col("cue"))
    strongest = F.max(rank).over(Window.partitionBy("post", "clause", "run").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    return runs.withColumn("before_cue", F.get(F.array(*map(F.lit, ROLES)), (strongest - 1).cast("int"))).drop("says_clear", "segment", "opens", "cuts", "run")


def _patterns(words: DataFrame, gazetteer: RoleGazetteer) -> tuple[DataFrame, int]:
    """A row for each pattern of each place, in file order, and the words of the longest."""
    rows, longest = [], 1
    for place in gazetteer.places:
        for pattern in place.patterns:
            longest = max(longest, len(pattern))
            rows.append((pattern[0][0][:KEY_LETTERS], len(rows), list(pattern), sorted(place.vetoed) if len(pattern) == 1 else [], place.max_suffix, place.capitalized, place.within, (place.id, place.name, place.lat, place.lon, place.reach_km)))
    schema = "key string, rank int, spelled array<struct<text:string,exact:boolean>>, vetoed array<string>, max_suffix int, capitalized boolean, within string, place struct<place_id:string,name:string,lat:double,lon:double,reach_km:int>"
    table = words.sparkSession.createDataFrame(rows, schema)
    return (F.broadcast(table) if len(rows) <= MAX_BROADCAST else table), longest


def _from_left(matches: Column) -> Column:
    """Of matches in order those that no earlier one of the result overlaps."""
    start = F.struct(F.lit(0).alias("free"), F.slice(matches, 1, 0).alias("kept"))
    take = lambda s, m: F.struct((m["pos"] + m["n"]).alias("free"), F.concat(s["kept"], F.array(m)).alias("kept"))
    return F.aggregate(matches, start, lambda s, m: F.when(m["pos"] >= s["free"], take(s, m)).otherwise(s), lambda s: s["kept"])


def found_places(words: DataFrame, gazetteer: RoleGazetteer) -> DataFrame:
    """``post, places``: what is named where, the longest pattern first, then file order; districts need their city named."""
    patterns, longest = _patterns(words, gazetteer)
    clause = Window.partitionBy("post", "clause").orderBy("pos").rowsBetween(0, longest - 1)
    ahead = words.select("post", "pos", "text", F.collect_list("plain").over(clause).alias("ahead") if longest > 1 else F.array("plain").alias("ahead"))
    keyed = ahead.withColumn("key", F.explode(F.array_distinct(F.array(*(F.left(F.get("ahead", F.lit(0)), F.lit(n)) for n in range(1, KEY_LETTERS + 1))))))
    fits = lambda p, w: (w == p["text"]) | (~p["exact"] & w.startswith(p["text"]) & (F.length(w) - F.length(p["text"]) <= F.col("max_suffix")))
    n = F.size("spelled")
    spelled = (F.size("ahead") >= n) & F.forall(F.zip_with("spelled", F.slice("ahead", F.lit(1), n), fits), lambda ok: ok)
    allowed = ~F.array_contains("vetoed", F.get("ahead", F.lit(0))) & (~F.col("capitalized") | T.is_capitalized("text"))
    named = keyed.join(patterns, "key").filter(spelled & allowed)
    by_post = named.groupBy("post").agg(F.array_sort(F.collect_list(F.struct("pos", (-n).alias("shorter"), "rank", n.alias("n"), "within", "place"))).alias("matches"))
    cities = F.transform(_from_left(F.filter("matches", lambda m: m["within"].isNull())), lambda m: m["place"]["place_id"])
    known = by_post.withColumn("cities", cities)
    return known.select("post", _from_left(F.filter("matches", lambda m: m["within"].isNull() | F.array_contains("cities", m["within"]))).alias("places"))


def placed_words(marked: DataFrame, gazetteer: RoleGazetteer) -> DataFrame:
    """Adds ``place`` (where one begins), ``covered`` (further words of one), ``unknown`` and ``role``."""
    named = marked.join(found_places(marked, gazetteer), "post", "left")
    at = lambda p, after: (p["pos"] < F.col("pos")) & (F.col("pos") < p["pos"] + p["n"]) if after else p["pos"] == F.col("pos")
    places = named.withColumn("place", F.get(F.filter("places", lambda p: at(p, False)), F.lit(0))["place"]).withColumn("covered", F.coalesce(F.exists("places", lambda p: at(p, True)), F.lit(False))).drop("places")
    silent = F.col("kind").isNull() & ~F.col("clears") & ~F.col("hit") & F.col("cue").isNull() & ~F.col("joins")
    items = places.withColumn("unknown", F.col("place").isNull() & ~F.col("covered") & silent & T.is_capitalized("text") & (F.length("plain") >= 4))
    item = F.col("place").isNotNull() | F.col("unknown")
    clause = Window.partitionBy("post", "clause").orderBy("pos")
    goes_on = F.last(F.when(~F.col("joins"), item | F.col("covered")), ignorenulls=True).over(clause.rowsBetween(Window.unboundedPreceding, -1))
    listed = items.withColumn("first", item & (F.col("before_cue").isNotNull() | ~F.coalesce(goes_on, F.lit(False))))
    # what goes on after a conjunction that is itself a place goes on with the list before it
    begun = F.last(F.when(F.col("first") & ~F.col("joins"), F.col("pos")), ignorenulls=True).over(clause)
    listed = listed.withColumn("list", F.when(F.col("first"), F.col("pos")).otherwise(begun))
    of_list = Window.partitionBy("post", "clause", "list").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lead = F.first(F.when(F.col("first"), F.struct("before_cue")), ignorenulls=True).over(of_list)["before_cue"]
    led = listed.withColumn("lead", lead).withColumn("lost", F.max("unknown").over(of_list))
    strong = F.col("lead").isin("target", "via")
    role = F.when((F.col("place").isNotNull() | F.col("unknown")) & strong, F.col("lead")).when(F.col("place").isNotNull(), F.when((F.col("lead") == "origin") & ~F.col("lost"), "origin").otherwise("mention"))
    return led.withColumn("role", role).drop("first", "list", "lead", "lost")


def _phrases(lexicon: Lexicon) -> Column:
    """Whether an all-clear of several words begins here, within the clause."""
    if not lexicon.phrases:
        return F.lit(False)
    ahead = F.collect_list("plain").over(Window.partitionBy("post", "clause").orderBy("pos").rowsBetween(0, max(map(len, lexicon.phrases)) - 1))
    return reduce(lambda a, p: a | (F.slice(ahead, 1, len(p)) == F.array(*map(F.lit, p))), lexicon.phrases, F.lit(False))


def clauses(placed: DataFrame, lexicon: Lexicon) -> DataFrame:
    """A row for each clause: ``kinds`` (in vocabulary order), ``counts``, ``inherited``, ``phase``, ``clear_word``, ``places``, ``unresolved``.

    A clause without a kind takes those of the last clause that has some, unless
    that one or itself is an all-clear: if it affects a place, and refers back, or
    begins with a number and that clause named no place.
    """
    clause = Window.partitionBy("post", "clause").orderBy("pos")
    seen = placed.withColumn("nth", F.count_if(~F.col("covered")).over(clause)).withColumn("phrase", ~F.col("covered") & _phrases(lexicon)).withColumn("initial", F.row_number().over(clause) == 1)
    says = F.col("place").isNull() & ~F.col("covered")
    back = ~F.col("covered") & ((F.col("nth") <= 2) & _in(F.col("plain"), lexicon.leads) | _in(F.col("plain"), lexicon.marks))
    rank = F.array_position(F.array(*map(F.lit, READER_KINDS)), F.col("kind"))
    role = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")).cast("int")
    summed = seen.groupBy("post", "clause").agg(
        *(F.first(n).alias(n) for n in META), F.array_sort(F.collect_set(F.when(says, rank))).alias("ranks"), F.array(*(F.max(F.when(says & (F.col("kind") == k), F.col("count"))) for k in READER_KINDS)).alias("counts"),
        F.max(says & F.col("kind").isNull() & F.col("clears")).alias("clear_word"), F.max("phrase").alias("phrase"), F.max(says & F.col("kind").isNull() & ~F.col("clears") & F.col("hit")).alias("hit"),
        F.max(back).alias("refers"), F.max(F.col("initial") & F.col("plain").rlike("^[0-9]+$")).alias("counted"),
        F.array_sort(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("pos", role.alias("role"), "place")))).alias("named"),
        F.array_sort(F.collect_list(F.when(F.col("unknown") & F.col("role").isNotNull(), F.struct("pos", "text")))).alias("missed"),
    )
    own = lambda id_: F.filter("named", lambda x: x["place"]["place_id"] == id_)
    strongest = lambda xs: F.get(F.array(*map(F.lit, ROLES)), F.array_max(F.transform(xs, lambda x: x["role"])) - 1)
    first = lambda xs: F.get(xs, F.lit(0))["place"]
    merged = F.transform(F.array_distinct(F.transform("named", lambda x: x["place"]["place_id"])), lambda i: F.struct(*(first(own(i))[n].alias(n) for n in ("place_id", "name", "lat", "lon", "reach_km")), strongest(own(i)).alias("role")))
    told = summed.select(
        "post", "clause", *META, F.transform("ranks", lambda r: F.get(F.array(*map(F.lit, READER_KINDS)), (r - 1).cast("int"))).alias("own_kinds"), "counts", "clear_word", "hit", "refers", "counted",
        (F.col("clear_word") | F.col("phrase")).alias("cleared"), merged.alias("places"), F.array_distinct(F.transform("missed", lambda x: x["text"])).alias("unresolved"),
    )
    before = Window.partitionBy("post").orderBy("clause").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.size("own_kinds") > 0, F.struct("own_kinds", "cleared", (F.size("places") > 0).alias("placed"))), ignorenulls=True).over(before)
    takes = (F.size("own_kinds") == 0) & ~F.col("cleared") & (F.size(affected()) > 0) & F.col("last").isNotNull() & ~F.col("last.cleared") & (F.col("refers") | F.col("counted") & ~F.col("last.placed"))
    carried = told.withColumn("last", last).withColumn("inherited", F.coalesce(takes, F.lit(False)))
    kinds = F.when(F.col("inherited"), F.col("last.own_kinds")).otherwise(F.col("own_kinds"))
    phase = F.when(F.col("cleared"), "cleared").when(F.col("hit"), "intercepted").otherwise("threat")
    return carried.withColumn("kinds", kinds).withColumn("phase", phase).drop("last", "own_kinds", "refers", "counted", "cleared", "hit")


def readings(of_clauses: DataFrame) -> DataFrame:
    """``READING`` rows: one for each kind of a clause, generic missiles aside where a special one is named, or one for an all-clear word without a kind."""
    special = F.arrays_overlap("kinds", F.array(F.lit("ballistic_missile"), F.lit("cruise_missile")))
    kinds = F.when(special, F.array_remove("kinds", "missile")).otherwise(F.col("kinds"))
    none = F.array(F.lit(None).cast("string"))
    of_kind = of_clauses.withColumn("kind", F.explode(F.when(F.size(kinds) > 0, kinds).when(F.col("clear_word"), none)))
    rank = F.array_position(F.array(*map(F.lit, READER_KINDS)), F.col("kind"))
    numbered = of_kind.withColumn("statement", F.row_number().over(Window.partitionBy("post").orderBy("clause", rank)) - 1)
    count = F.when(F.col("kind").isNotNull(), F.get("counts", (rank - 1).cast("int")))
    return numbered.select(*META, "statement", "kind", F.col("inherited").alias("kind_inherited"), "phase", count.alias("count"), "places", "unresolved")


def read(evidence: DataFrame, lexicon: Lexicon, gazetteer: RoleGazetteer, max_chars: int = MAX_TEXT_CHARS) -> DataFrame:
    """``READING`` rows of posts that have a text of at most ``max_chars``. One shuffle, of words by post."""
    return readings(clauses(placed_words(marked_words(split_words(evidence, max_chars), lexicon), gazetteer), lexicon))


def affected(places: Column | str = "places") -> Column:
    return F.filter(F.col(places) if isinstance(places, str) else places, lambda p: p["role"].isin("target", "via"))


def actionable() -> Column:
    return (F.col("phase") == "threat") & F.col("kind").isNotNull() & (F.size(affected()) > 0)


def coverage(read_: DataFrame, top: int = 20) -> tuple[DataFrame, DataFrame]:
    """Counts of readings, and the words most often left unresolved."""
    counts = read_.agg(F.count(F.lit(1)).alias("readings"), F.count_if(actionable()).alias("actionable"), F.count_if(F.col("kind_inherited")).alias("inherited"))
    words = read_.select(F.explode("unresolved").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(top)
    return counts, words
