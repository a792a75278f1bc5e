"""Whole runs over all samples at once: E1 graph-checked answering, E2 direct answering,
E3 graph comparison, the search agent (G12-G14, R9-R12, K6, L11).

Loops run on the driver over steps (entities of the longest path, turns, paths);
each step is one job for all samples. `keep` turns a step's result into a table:
sources.tables.stage_table with a path on a cluster.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import generated as P
from ..operators import graph as G
from ..operators import retrieval as R
from ..operators import scoring, selection, triples, verification
from ..operators.index import Index
from ..operators.scan import Scan
from ..sources import models
from ..sources.tables import EngineConfig, GraphTable, MemoTable

Keep = Callable[[DataFrame], DataFrame]


class Corpus:
    """A corpus (doc_id, contents) with its index, which is built once and read by every step. Hits are (qid, ord, doc_id, evidence)."""

    def __init__(self, docs: DataFrame, keep: Keep, max_words: int = 500, index: Index | Scan | None = None):
        """index: that of a stored index's segments, or a scan of the docs for a run that searches a few times; else it is built."""
        self.keep, self.docs, self.max_words = keep, docs, max_words
        self.index = index or Index.build(docs, keep)

    def read(self, found: DataFrame) -> DataFrame:
        """A table (doc_id, ...) with evidence: only passages that are found are made, and no copy of the others is kept. A table, as what is
        asked of the evidence would be asked of all documents else, before those that are found are picked."""
        return found.join(self.keep(R.passages(R.among(self.docs, found), self.max_words).select("doc_id", "evidence")), "doc_id")

    def hits(self, queries: DataFrame, top_k: int) -> DataFrame:
        """Each distinct query text is searched once."""
        texts = self.keep(queries.select(F.xxhash64("query").alias("qid"), "query").distinct())
        # a table, whose size Spark knows: passages stay where they are
        found = self.read(self.keep(self.index.top_k(texts, top_k, self.keep)))
        return queries.select("qid", F.xxhash64("query").alias("h")).join(found.withColumnRenamed("qid", "h"), "h").select("qid", F.col("rank").alias("ord"), "doc_id", "evidence")

    def assembled(self, queries: DataFrame, gold: DataFrame, config: EngineConfig, hits: DataFrame | None = None, total: bool = False) -> DataFrame:
        """(qid, pos, doc_id, is_gold, evidence) under the setting. gold: (index, ord, doc_id, evidence); queries (qid, index, query)."""
        own = queries.select("qid", "index").join(gold, "index").select("qid", "ord", "doc_id", "evidence")
        return R.assemble(own, self.hits(queries, config.top_k) if hits is None else hits, config.setting, config.top_k, total)

    def evidence(self, queries: DataFrame, gold: DataFrame, config: EngineConfig, hits: DataFrame | None = None, total: bool = False) -> DataFrame:
        """(qid, evidence): the assembled passages as one text, '' if there are none."""
        rows = self.assembled(queries, gold, config, hits, total)
        return queries.select("qid").join(R.evidence_text(rows, config.evidence_chars), "qid", "left").select("qid", F.coalesce("text", F.lit("")).alias("evidence"))


def direct(samples: DataFrame, corpus: Corpus, gold: DataFrame, model: models.Backend, config: EngineConfig, keep: Keep) -> DataFrame:
    """(index, question, answer, num_hops) -> predicted_answer, em_score, f1_score. With use_agent the agent searches."""
    samples = selection.first_rows(samples, config.max_samples)
    queries = samples.select(F.col("index").alias("qid"), "index", F.col("question").alias("query"))
    hits = agent_hits(queries, corpus, model, config, keep) if config.use_agent else None
    evidence = corpus.evidence(queries, gold, config, hits, config.use_agent and config.total_results)
    # a table, for the model's prompts and the rows that their answers go back to
    asked = keep(samples.join(evidence.withColumnRenamed("qid", "index"), "index"))
    done = models.answer(asked, model, config.evidence_chars).drop("evidence")
    return selection.fallback(scoring.score(done, aliases="answer_aliases" if "answer_aliases" in samples.columns else None))


def _bound(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """rows (index, bindings, ...) with the facts of their samples, in which the bound entities are replaced one after the other."""
    put = F.aggregate("bindings", F.col("triple"), lambda t, x: F.replace(t, x["ent"], x["value"]))
    return rows.join(facts, "index").withColumn("triple", put)


_NOTHING = "cast(array() as array<struct<ent: string, value: string>>)"


class Prefixes:
    """What is known of beginnings of paths, as tables of (index, prefix, bindings, infilling_index, ent, search, query,
    infilled, confidence, status). A prefix's last entity was searched for and filled in with the ones before it bound; paths that
    begin with the same entities share that, whichever wave they come in."""

    def __init__(self, facts: DataFrame):
        self.facts, self.parts = facts, []

    def table(self) -> DataFrame | None:
        out = None
        for t in self.parts:
            out = t if out is None else out.unionByName(t)
        return out

    def bindings(self, paths: DataFrame) -> DataFrame:
        """paths (index, path, ...) with their bindings, and the confidence of the last entity (null without one)."""
        known = self.table()
        if known is None:
            return paths.withColumns({"bindings": F.expr(_NOTHING), "confidence": F.lit(None).cast("double")})
        own = known.select("index", F.col("prefix").alias("path"), "bindings", "confidence")
        return paths.join(own, ["index", "path"], "left").withColumn("bindings", F.coalesce("bindings", F.expr(_NOTHING)))

    def extend(self, paths: DataFrame, corpus: Corpus, gold: DataFrame, model: models.Backend, config: EngineConfig, keep: Keep, by_start: DataFrame | None = None) -> None:
        """Fill the prefixes of paths (index, path) that aren't known yet, a place of all paths at a time."""
        for i in range(paths.agg(F.max(F.size("path"))).first()[0] or 0):
            want = paths.where(F.size("path") > i).select("index", F.slice("path", 1, i + 1).alias("prefix")).distinct()
            known = self.table()
            if known is not None:
                want = want.join(known.select("index", "prefix"), ["index", "prefix"], "left_anti")
            want = self.bindings(want.withColumn("path", F.slice("prefix", 1, i))).drop("path", "confidence") if i else want.withColumn("bindings", F.expr(_NOTHING))
            want = want.withColumns({"gid": F.concat_ws("/", "index", F.array_join("prefix", ",")), "ent": F.element_at("prefix", -1)})
            graph = triples.open_definitions(_bound(want.select("index", "gid", "bindings"), self.facts)).select(F.col("gid").alias("index"), "kind", "pos", "triple")
            defs = triples.definitions(graph.where("kind = 'definition'"))
            search = G.agent_query(graph, defs) if config.use_agent else G.retrieval_query(graph, defs)
            both = search.withColumnRenamed("query", "search").join(G.infill_query(graph, defs), ["index", "ent"]).withColumnRenamed("index", "gid")
            own = defs.select(F.col("index").alias("gid"), "ent", F.col("definition").alias("fallback"))
            work = keep(want.join(both, ["gid", "ent"]).join(own, ["gid", "ent"]))
            if work.isEmpty():
                continue
            if by_start is not None:
                found = by_start.select("index", F.col("ent").alias("start"), "evidence")
                asked = work.withColumn("start", F.get("prefix", F.lit(0))).join(found, ["index", "start"], "left").withColumn("evidence", F.coalesce("evidence", F.lit(""))).drop("start")
            else:
                queries = work.select(F.col("gid").alias("qid"), "index", F.col("search").alias("query"))
                hits = agent_hits(queries, corpus, model, config, keep) if config.use_agent else None
                asked = work.join(corpus.evidence(queries, gold, config, hits, config.use_agent and config.total_results).withColumnRenamed("qid", "gid"), "gid")
            bound = F.concat("bindings", F.array(F.struct("ent", F.col("infilled").alias("value"))))
            filled = models.infill(keep(asked), model)
            self.parts.append(keep(filled.select("index", "prefix", bound.alias("bindings"), F.lit(i).alias("infilling_index"), "ent", "search", "query", "infilled", "confidence", "status")))


def infill_paths(paths: DataFrame, facts: DataFrame, corpus: Corpus, gold: DataFrame, model: models.Backend, config: EngineConfig, keep: Keep, by_start: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(facts with entities filled in by path, log). paths: (index, path_index, path);
    facts: (index, kind, pos, triple). Step i fills the i-th entity of every path.
    by_start: (index, ent, evidence) retrieved beforehand for start entities (J8); else every step searches, by the
    agent's query and the agent if the configuration says so."""
    known = Prefixes(facts)
    known.extend(paths.select("index", "path"), corpus, gold, model, config, keep, by_start)
    state = _bound(known.bindings(paths.select("index", "path_index", "path")).drop("path", "confidence"), facts).drop("bindings")
    steps = paths.select("index", "path_index", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.slice("path", 1, n))).alias("prefix")) if known.parts else None
    if steps is None:
        return state, state.sparkSession.createDataFrame([], f"index {dict(paths.dtypes)['index']}, path_index int, infilling_index int, ent string, search string, query string, infilled string, confidence double, status string")
    return state, steps.join(known.table().drop("bindings"), ["index", "prefix"]).drop("prefix")


def verify_claims(claims: DataFrame, corpus: Corpus, gold: DataFrame, model: models.Backend, config: EngineConfig, keep: Keep) -> DataFrame:
    """Claims (qid, index, claim) -> (qid, supported, confidence, supported_doc_id, tier): on all evidence together,
    document by document up to the first that supports, or the second where the first fails. The documents go in waves: the
    next one of each claim is asked only if none before it supported the claim. Evidence always comes
    from plain search (Q25). Without evidence no document supports, and the confidence is null (Q3)."""
    rows = keep(corpus.assembled(claims.select("qid", "index", F.col("claim").alias("query")), gold, config))

    def judged(asked: DataFrame) -> DataFrame:
        return models.verify(asked, model).withColumn("supported", F.coalesce("supported", F.lit(False)))

    whole = each = None
    if config.document_level != "each":
        text = claims.select("qid", "claim").join(R.evidence_text(rows, config.evidence_chars), "qid", "left").select("qid", "claim", F.coalesce("text", F.lit("")).alias("evidence"))
        whole = keep(judged(keep(text)).select(F.col("qid").alias("claim_id"), "supported", "confidence"))
    if config.document_level != "concat":
        left = claims if whole is None else claims.join(whole.where("not supported").select(F.col("claim_id").alias("qid")), "qid", "left_semi")
        asked = keep(left.select("qid", "claim").join(rows, "qid").select("qid", "pos", "doc_id", "claim", F.substring("evidence", 1, config.evidence_chars).alias("evidence")))
        open_ = None
        for pos in range((asked.agg(F.max("pos")).first()[0] or 0) + 1):
            now = asked.where(F.col("pos") == pos)
            if open_ is not None:
                now = keep(now.join(open_, "qid", "left_semi"))
                if now.isEmpty():
                    break
            got = keep(judged(now).select(F.col("qid").alias("claim_id"), "pos", F.col("doc_id").cast("string").alias("doc_id"), "supported", "confidence"))
            each = got if each is None else each.unionByName(got)
            open_ = got.where("not supported").select(F.col("claim_id").alias("qid"))
    if whole is None:
        whole = claims.select(F.col("qid").alias("claim_id"), F.lit(False).alias("supported"), F.lit(None).cast("double").alias("confidence"))
    if each is None:
        each = claims.sparkSession.createDataFrame([], f"claim_id {dict(claims.dtypes)['qid']}, pos int, doc_id string, supported boolean, confidence double")
    return verification.tiers(whole, each).withColumnRenamed("claim_id", "qid")


def start_evidence(samples: DataFrame, facts: DataFrame, paths: DataFrame, corpus: Corpus, gold: DataFrame, model: models.Backend, config: EngineConfig, keep: Keep, memo: MemoTable | None = None) -> DataFrame:
    """(index, ent, evidence) for every entity that starts a path (Q9): a thought about
    the entity's own question seeds the agent, which searches for the sample's question. New thoughts go into the memo."""
    defs = triples.definitions(facts.where("kind = 'definition'"))
    starts = paths.select("index", F.get("path", F.lit(0)).alias("ent")).where("ent is not null").distinct()
    own = keep(starts.join(G.agent_query(facts, defs), ["index", "ent"]).withColumn("prompt", T.prompt(models.TEMPLATES["nudge"], question=F.col("query"))).drop("query"))
    thoughts = keep(remembered(own, memo, model, keep))
    asked = own.join(thoughts, "prompt").join(samples.select("index", "question"), "index").withColumn("qid", F.xxhash64("index", "ent"))
    queries = keep(asked.select("qid", "index", "ent", F.col("question").alias("query"), F.col("value").alias("thinking")))
    hits = agent_hits(queries, corpus, model, config, keep)
    evidence = corpus.evidence(queries, gold, config, hits, config.total_results)
    return keep(queries.join(evidence, "qid").select("index", "ent", "evidence"))


def graph_check(samples: DataFrame, facts: DataFrame, corpus: Corpus, gold: DataFrame, model: models.Backend, config: EngineConfig, keep: Keep, memo: MemoTable | None = None) -> DataFrame:
    """Verdict, best path, answer and scores of each sample. samples: (index, question, answer,
    num_hops); facts: (index, kind, pos, triple). Only `answer` is scored, aliases aren't (Q4).

    W5: paths go in waves. A wave fills and verifies the next path of those samples that no path before has supported;
    what earlier waves know of a path's beginning, or of a claim, isn't asked again."""
    samples, facts = selection.first_rows(samples, config.max_samples), keep(facts)
    defs = triples.definitions(facts.where("kind = 'definition'"))
    nudged = config.use_agent and config.nudge
    make = G.varied_paths if nudged else G.valid_paths
    paths = make(facts, defs, config.path_limit, config.seed).join(samples.select("index"), "index", "left_semi").select("index", "path_index", "path")
    # a sample without entities has one empty path
    lone = samples.select("index").join(paths.select("index").distinct(), "index", "left_anti").select("index", F.lit(0).alias("path_index"), F.array().cast("array<string>").alias("path"))
    paths = keep(paths.unionByName(lone))
    by_start = start_evidence(samples, facts, paths, corpus, gold, model, config, keep, memo) if nudged else None
    known, verified, seen, open_ = Prefixes(facts), None, None, None
    for wave in range((paths.agg(F.max("path_index")).first()[0] or 0) + 1):
        here = paths.where(F.col("path_index") == wave)
        if open_ is not None:
            here = keep(here.join(open_, "index", "left_semi"))
            if here.isEmpty():
                break
        known.extend(here.select("index", "path"), corpus, gold, model, config, keep, by_start)
        filled = keep(known.bindings(here))
        claims = keep(_bound(filled.select("index", "path_index", "bindings"), facts).select("index", "path_index", T.sentence(F.col("triple")).alias("claim")).where("claim is not null"))
        # every distinct claim of a sample is searched and verified once
        new = claims.select("index", "claim").distinct()
        if verified is not None:
            new = new.join(verified.select("index", "claim"), ["index", "claim"], "left_anti")
        new = keep(new.withColumn("qid", F.xxhash64("index", "claim")))
        if not new.isEmpty():
            told = keep(new.join(verify_claims(new, corpus, gold, model, config, keep), "qid").select("index", "claim", "supported"))
            verified = told if verified is None else verified.unionByName(told)
        held = claims.join(verified, ["index", "claim"]) if verified is not None else claims.withColumn("supported", F.lit(True))
        verdicts = verification.path_verdicts(held, here)
        # the last infilled entity's confidence (Q2); 0 without one (Q1)
        verdicts = keep(verdicts.join(filled.select("index", "path_index", F.coalesce("confidence", F.lit(0.0)).alias("infill")), ["index", "path_index"]))
        seen = verdicts if seen is None else seen.unionByName(verdicts)
        open_ = verdicts.where("not supported").select("index")
    best = keep(verification.best_path(seen, "infill"))
    chosen = known.bindings(paths.join(best.select("index", F.col("best_path_index").alias("path_index")), ["index", "path_index"]))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("kind", "pos", "triple"))), lambda x: T.readable(x["triple"]))
    text = _bound(chosen.select("index", "bindings"), facts).groupBy("index").agg(F.array_join(ordered, "\n").alias("evidence"))
    asked = keep(samples.join(text, "index", "left").withColumn("evidence", F.coalesce("evidence", F.lit(""))))
    done = selection.fallback(scoring.score(models.answer(asked, model, config.evidence_chars).drop("evidence", "confidence")))
    return done.join(best, "index", "left").withColumn("prediction", F.when(F.col("supported"), "SUPPORTED").when(~F.col("supported"), "NOT_SUPPORTED"))


def agent_loop(questions: DataFrame, corpus: Corpus, ask: Callable[[DataFrame, int], DataFrame], config: EngineConfig, keep: Keep, thinking: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Turns of search until an answer or max_turns. questions: (qid, index, question[, thinking]);
    ask(rows with prompt, turn) adds text. Gives (state, turns (qid, turn, rank, doc_id)). A turn's query is looked for
    in what was generated, not in the instructions (Q22)."""
    start = T.prompt(models.TEMPLATES["agent"], question=T.question_mark(F.col("question")))
    if thinking:
        start = F.concat(start, F.lit("\n<think>"), F.coalesce(thinking, F.lit("")), F.lit("</think>"))
    state = keep(questions.select("qid", "index", start.alias("prompt"), F.lit("").alias("response"), F.lit(None).cast("string").alias("answer"), F.lit(0).alias("num_turns"), F.lit(True).alias("active")))
    turns = None
    for turn in range(config.max_turns):
        active = state.where("active")
        said = keep(ask(active, turn).select("qid", T.cut_at(F.col("text"), STOPS).alias("text")))
        parsed = said.select("qid", "text", T.strip(T.last_tag(F.col("text"), "search")).alias("query"), T.strip(T.last_tag(F.col("text"), "answer")).alias("found"))
        hits = corpus.hits(parsed.where("found is null and query is not null").select("qid", "query"), config.agent_top_k)
        now = keep(hits.select("qid", F.lit(turn).alias("turn"), F.col("ord").alias("rank"), "doc_id"))
        turns = now if turns is None else turns.unionByName(now)
        block = R.numbered(hits.withColumnRenamed("ord", "pos"))
        step = parsed.join(block, "qid", "left")
        grown = F.concat(F.col("prompt"), F.col("text"), F.coalesce(F.concat(F.lit("\n<information>"), "block", F.lit("</information>\n")), F.lit("")))
        open_ = F.col("text").isNotNull() & F.col("found").isNull() & F.col("query").isNotNull()
        joined = state.join(step, "qid", "left")
        state = keep(
            joined.select("qid", "index", F.when(F.col("text").isNull(), F.col("prompt")).otherwise(grown).alias("prompt"), F.concat("response", F.coalesce("text", F.lit(""))).alias("response"), F.coalesce("answer", "found").alias("answer"), (F.col("num_turns") + F.col("text").isNotNull().cast("int")).alias("num_turns"), (F.col("active") & open_).alias("active"))
        )
        if state.where("active").isEmpty():
            break
    return state, turns


#: Where a turn of the agent ends (fixed values)
STOPS = ("</search>", " </search>", "</search>\n", " </search>\n", "</search>\n\n", " </search>\n\n")


def agent_hits(queries: DataFrame, corpus: Corpus, model: models.Backend, config: EngineConfig, keep: Keep) -> DataFrame:
    """The agent's passages for queries (qid, query[, thinking]): (qid, ord, doc_id, evidence); each distinct
    query and thought runs once. The last search's, at most top_k, or with total_results all searches'."""
    thought = F.coalesce("thinking", F.lit("")) if "thinking" in queries.columns else F.lit("")
    keyed = queries.select("qid", F.col("query").alias("question"), thought.alias("thinking")).withColumn("h", F.xxhash64("question", "thinking"))
    asked = keep(keyed.select(F.col("h").alias("qid"), F.col("h").alias("index"), "question", "thinking").distinct())
    _, turns = agent_loop(asked, corpus, lambda rows, _: models.generate(rows, model, batch=config.batch_size), config, keep, "thinking" if config.nudge else None)
    found = R.turn_results(turns, config.total_results)
    if not config.total_results:
        found = found.where(F.col("pos") < config.agent_top_k)
    own = corpus.read(keep(found)).withColumnRenamed("qid", "h")
    return keyed.select("qid", "h").join(own, "h").select("qid", F.col("pos").alias("ord"), "doc_id", "evidence")


def nudges(prompts: DataFrame, memo: DataFrame, model: models.Backend) -> tuple[DataFrame, DataFrame]:
    """(prompt, value) of all distinct prompts, and the new ones to append to the memo."""
    known, missing = selection.with_memo(prompts.select("prompt").distinct(), memo)
    new = models.generate(missing, model).select("prompt", F.get(F.split("text", "\n"), F.lit(0)).alias("value"))
    return known.unionByName(new), new


def remembered(prompts: DataFrame, memo: MemoTable | None, model: models.Backend, keep: Keep) -> DataFrame:
    """(prompt, value) of all distinct prompts; only those that the memo lacks are asked, and added to it."""
    asked = prompts.select("prompt").distinct()
    known = memo.lookup(asked) if memo is not None else asked.select("prompt", F.lit("").alias("value")).limit(0)
    _, new = nudges(asked, known, model)
    new = keep(new)
    if memo is not None:
        memo.append(new)
    return known.unionByName(new)


#: Pairings of E3
PAIRINGS = {"cot_doc": ("cot", "doc"), "cot_gold": ("cot", "gold"), "gold_doc": ("gold", "doc"), "question_doc": ("question", "doc"), "question_gold": ("question", "gold")}


def compare_graphs(graphs: DataFrame, pairings: tuple[str, ...] = tuple(PAIRINGS)) -> DataFrame:
    """(index, source, triple) -> one row per sample and pairing."""
    out = None
    for name in pairings:
        one = triples.compare(graphs, *PAIRINGS[name]).withColumn("pairing", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def compare_run(samples: DataFrame, corpus: Corpus, gold: DataFrame, model: models.Backend, config: EngineConfig, keep: Keep) -> tuple[DataFrame, DataFrame]:
    """(samples with the state of each: ok, no question, no reasoning; comparisons by sample and pairing).

    Per sample: a chain of thought with its triples (anew while empty, cot_retry times), passages by the retrieval
    strategy, triples of those passages, of the gold passages and, with compare_question, of the question."""
    samples, silent = selection.with_question(selection.first_rows(samples, config.max_samples))
    cot = keep(retry_empty(samples.select("index", "question"), lambda rows, n: chain_of_thought(rows, model, n), config.cot_retry, keep))
    own = cot_facts(cot).withColumn("source", F.lit("cot"))
    read = keep(own)
    arrays = lambda rows, kind, name: rows.where(F.col("kind") == kind).groupBy("index").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "triple"))), lambda x: x["triple"]).alias(name))
    asked = samples.join(cot.select("index", F.col("reasoning").alias("cot_reasoning")), "index", "left")
    graphs = read.select("index", "source", "triple")
    parts = [(read, "cot")]
    if config.compare_question or config.strategy == "question_triplets":
        facts = keep(construct(samples, model, keep))
        parts.append((facts, "question"))
        if config.compare_question:
            graphs = graphs.unionByName(facts.select("index", F.lit("question").alias("source"), "triple"))
    for rows, kind in parts:
        asked = asked.join(arrays(rows, "definition", f"{kind}_def_triples"), "index", "left").join(arrays(rows, "relation", f"{kind}_triples"), "index", "left")
    for c in ("question_def_triples", "question_triples"):
        if c not in asked.columns:
            asked = asked.withColumn(c, F.lit(None).cast("array<string>"))
    queries = keep(R.strategy_queries(asked, config.strategy, config.use_agent, config.nudge).withColumn("qid", F.xxhash64("index", "hop")))
    hits = agent_hits(queries, corpus, model, config, keep) if config.use_agent else None
    found = corpus.assembled(queries, gold, config, hits, config.use_agent and config.total_results).join(queries.select("qid", "index", "hop"), "qid")
    passages = keep(corpus.read(keep(R.multihop_union(found.select("index", "hop", F.col("pos").alias("rank"), "doc_id")))))
    doc = document_facts(passages.select("index", "pos", F.col("evidence").alias("document")), model, keep)
    told = document_facts(gold.select("index", F.col("ord").alias("pos"), F.col("evidence").alias("document")), model, keep)
    graphs = graphs.unionByName(doc.select("index", F.lit("doc").alias("source"), "triple")).unionByName(told.select("index", F.lit("gold").alias("source"), "triple"))
    pairings = tuple(p for p in PAIRINGS if config.compare_question or not p.startswith("question"))
    state = asked.select("index", F.when(F.coalesce("cot_reasoning", F.lit("")) == "", "no reasoning").otherwise("ok").alias("state")).unionByName(silent.select("index", F.lit("no question").alias("state")))
    return state, compare_graphs(keep(graphs), pairings)


def retry_empty(rows: DataFrame, make: Callable[[DataFrame, int], DataFrame], retries: int, keep: Keep) -> DataFrame:
    """Rows whose text is empty are generated anew, at most `retries` times more. make(rows, attempt) gives (index, text, ...)."""
    done = None
    left = rows
    for attempt in range(retries + 1):
        got = keep(make(left, attempt))
        good = got.where("coalesce(text, '') <> ''") if attempt < retries else got
        done = good if done is None else done.unionByName(good)
        left = left.join(good.select("index"), "index", "left_anti")
        if left.isEmpty():
            break
    return done


def chain_of_thought(rows: DataFrame, model: models.Backend, attempt: int = 0) -> DataFrame:
    """(index, question) -> (index, answer, reasoning, text: the answer if it has reasoning). A later attempt asks by another line, so that it
    isn't the same prompt."""
    again = F.lit("" if not attempt else f"\n# Attempt: {attempt + 1}")
    asked = rows.withColumn("prompt", F.concat(T.prompt(models.TEMPLATES["cot_with_triples"], question=F.col("question")), again))
    said = models.generate(asked, model).select("index", F.coalesce("text", F.lit("")).alias("answer"))
    read = said.withColumn("reasoning", P.cot_text("answer"))
    return read.withColumn("text", F.when(F.col("reasoning") != "", F.col("answer")))


def cot_facts(rows: DataFrame) -> DataFrame:
    """L2, L3 on answers (index, answer): (index, kind, pos, triple)."""
    defs = P.latent_lines(rows, "answer")
    return _facts(defs, P.triple_lines(rows, defs, "answer"))


def _facts(defs: DataFrame, relations: DataFrame) -> DataFrame:
    return defs.withColumn("kind", F.lit("definition")).unionByName(relations.withColumn("kind", F.lit("relation"))).select("index", "kind", "pos", "triple")


def reasoning_facts(rows: DataFrame, model: models.Backend, keep: Keep) -> DataFrame:
    """(index, reasoning) -> (index, kind, pos, triple)."""
    asked = rows.withColumn("prompt", T.prompt(models.TEMPLATES["cot_triples"], reasoning=F.col("reasoning")))
    return cot_facts(keep(models.generate(asked, model).select("index", F.coalesce("text", F.lit("")).alias("answer"))))


def document_facts(rows: DataFrame, model: models.Backend, keep: Keep) -> DataFrame:
    """(index, pos, document) -> (index, doc_pos, pos, triple): all facts of a sample's documents; each document is read once."""
    asked = rows.where("document is not null").select("index", F.col("pos").alias("doc_pos"), "document").withColumn("prompt", T.prompt(models.TEMPLATES["document_triples"], document=F.col("document")))
    said = keep(models.generate(asked, model).select(F.struct("index", "doc_pos").alias("index"), F.coalesce("text", F.lit("")).alias("text")))
    return P.triple_lines(said).select("index.index", "index.doc_pos", "pos", "triple")


def construct(samples: DataFrame, model: models.Backend, keep: Keep) -> DataFrame:
    """L4: latent entities, then facts that mention them: (index, kind, pos, triple). Rows of failed calls give none."""
    first = keep(models.generate(samples.withColumn("prompt", T.prompt(models.TEMPLATES["latent"], question=F.col("question"))), model).select("index", "question", F.coalesce("text", F.lit("")).alias("text")))
    latent = P.latent_lines(first)
    listed = latent.groupBy("index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "triple"))), lambda x: x["triple"]), "\n").alias("latent"))
    second = first.select("index", "question").join(listed, "index", "left").withColumn("prompt", T.prompt(models.TEMPLATES["triples"], latent=F.coalesce("latent", F.lit("(no latent entities)")), question=F.col("question")))
    facts = P.triple_lines(keep(models.generate(second, model).select("index", F.coalesce("text", F.lit("")).alias("text"))), latent)
    return _facts(latent, facts)


def construct_at_once(samples: DataFrame, model: models.Backend, keep: Keep) -> DataFrame:
    """One prompt per sample, in the batches that the backend sends."""
    asked = samples.withColumn("prompt", T.prompt(models.TEMPLATES["single_step"], question=F.col("question")))
    return P.sections(keep(models.generate(asked, model).select("index", F.coalesce("text", F.lit("")).alias("text"))))


def construct_graphs(samples: DataFrame, graphs: GraphTable, model: models.Backend, keep: Keep, at_once: bool = False, force: bool = False) -> DataFrame:
    """(index, kind, pos, triple) of the samples; only those that the table doesn't have are constructed, and
    added to it. Samples that gave no fact aren't stored, so the next run tries them again."""
    done = None if force else graphs.read()
    left = samples if done is None else selection.remaining(samples, done)
    new = (construct_at_once if at_once else construct)(left, model, keep)
    graphs.write(new, replace=force)
    return selection.with_index(graphs.read(), samples)
