"""Command line: ``python -m evigraph COMMAND``.

Exit codes: 0 done, 1 nothing to evaluate, 2 a query or reference that makes no sense,
130 interrupted.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph import engine
from evigraph.investigate import Investigation
from evigraph.ontology import Ontology, default_ontology
from evigraph.operators.scoring import explain, score_pairs
from evigraph.plans.english import NaturalLanguage
from evigraph.plans.language import QueryError
from evigraph.runtime import local_session
from evigraph.sources import synthetic
from evigraph.sources.adapters import ingest


def _uri(path: str) -> str:
    return path if "://" in path else "file://" + os.path.abspath(path)


def _table(frame: DataFrame) -> str:
    """All rows of an answer; the query's own limit says how many there are."""
    keep = [c for c in ("id", "label", "entity_type", "risk", "degree", "records", "hops", "path") if c in frame.columns] or frame.columns
    show = lambda v: f"{v:.3f}" if isinstance(v, float) else " > ".join(v) if isinstance(v, list) else str(v)
    return "\n".join("  ".join(show(r[c]) for c in keep) for r in frame.select(*keep).toLocalIterator()) or "nothing found"


class Commands:
    def __init__(self, args: argparse.Namespace) -> None:
        self.args = args
        self.ontology = Ontology.load(args.ontology) if args.ontology else default_ontology()
        self._spark: SparkSession | None = None

    @property
    def spark(self) -> SparkSession:
        if self._spark is None:
            self._spark = SparkSession.getActiveSession() or local_session()
            self._spark.sparkContext.setLogLevel("ERROR")
        return self._spark

    def say(self, text: str) -> None:
        if not self.args.quiet:
            print(text, file=sys.stderr)

    def analysed(self) -> engine.Run:
        if not os.path.isdir(self.args.data) and "://" not in self.args.data:
            self.say(f"no folder {self.args.data}: generating a corpus")
            synthetic.generate(self.spark, _uri(self.args.data))
        run = engine.run(self.spark, _uri(self.args.data), self.ontology)
        self.say("  ".join(f"{k} {v:.1f}s" for k, v in run.timings.items()))
        return run

    def generate(self) -> int:
        meta = synthetic.generate(self.spark, _uri(self.args.out), self.args.seed, self.args.people, self.args.orgs, self.args.noise)
        print(f"{meta['people']} people, {meta['organizations']} organizations in {self.args.out}")
        return 0

    def ontology_(self) -> int:
        print(self.ontology.summary())
        return 0

    def run(self) -> int:
        run = self.analysed()
        if self.args.out:
            run.save(_uri(self.args.out))
        print(Investigation(run).case_report(self.args.cases))
        return 0

    def eval(self) -> int:
        run = self.analysed()
        if run.labelled is None:
            print("the folder has no truth.json", file=sys.stderr)
            return 1
        for r in run.evaluation().orderBy("entity_type").collect():
            print(f"{r.entity_type}: precision {r.precision:.4f}, recall {r.recall:.4f}, F1 {r.f1:.4f}, exact {r.exact_clusters} of {r.true_entities}")
        merges, splits = run.errors(self.args.examples)
        for r in merges.collect():
            print(f"merged wrongly: {r.entity_id} holds {', '.join(r.truths)}")
        for r in splits.collect():
            print(f"split: {r.truth_id} is in {', '.join(r.entities)}")
        return 0

    def query(self) -> int:
        print(_table(Investigation(self.analysed()).engine.query(self.args.text)))
        return 0

    def ask(self) -> int:
        made, answer = NaturalLanguage(self.ontology).ask(Investigation(self.analysed()).engine, self.args.text)
        print(f"{made.query}   ({made.reasoning}, {made.provider})\n{_table(answer)}")
        return 0

    def dossier(self) -> int:
        print(Investigation(self.analysed()).dossier(self.args.ref))
        return 0

    def connect(self) -> int:
        print(Investigation(self.analysed()).connect(self.args.left, self.args.right, self.args.hops, self.args.limit))
        return 0

    def cases(self) -> int:
        print(Investigation(self.analysed()).case_report(self.args.limit))
        return 0

    def risk(self) -> int:
        print(_table(Investigation(self.analysed()).top_risk(self.args.type, self.args.limit)))
        return 0

    def explain(self) -> int:
        data = ingest(self.spark, _uri(self.args.data), self.ontology)
        for kind, records in data.records.items():
            two = records.where(F.col("key").isin(self.args.left, self.args.right))
            at = {r.key: r.pos for r in two.select("key", "pos").collect()}
            if len(at) == 2:
                pair = self.spark.createDataFrame([(at[self.args.left], at[self.args.right])], "l long, r long")
                r = score_pairs(two, pair, self.ontology.entity(kind)).first()
                print(explain(r.evidence, r.score, r.verdict))
                return 0
        raise QueryError("both records must exist and be of one type")

    def demo(self) -> int:
        if not os.path.isdir(self.args.data):
            synthetic.generate(self.spark, _uri(self.args.data))
        run = self.analysed()
        view = Investigation(run)
        for r in run.evaluation().orderBy("entity_type").collect():
            print(f"{r.entity_type}: precision {r.precision:.4f}, recall {r.recall:.4f}")
        best = view.top_risk("person", 2).collect()
        print(view.case_report(1), _table(view.top_risk()), view.dossier(best[0].id), view.connect(best[0].id, best[1].id), sep="\n\n")
        return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="evigraph", description=__doc__)
    top.add_argument("--ontology")
    top.add_argument("--data", default="data")
    top.add_argument("-q", "--quiet", action="store_true")
    sub = top.add_subparsers(dest="command", required=True)
    add = lambda name, *options: [(p := sub.add_parser(name)), *[p.add_argument(*a, **k) for a, k in options]]
    opt = lambda name, default, kind=int: ((name,), {"default": default, "type": kind})
    arg = lambda name, **k: ((name,), k)
    add("generate", opt("--out", "data", str), opt("--seed", 20260813), opt("--people", 300), opt("--orgs", 80), opt("--noise", 0.28, float))
    add("ontology")
    add("run", opt("--out", None, str), opt("--cases", 2))
    add("eval", opt("--examples", 3))
    add("query", arg("text"))
    add("ask", arg("text"))
    add("dossier", arg("ref"))
    add("connect", arg("left"), arg("right"), opt("--hops", 4), opt("--limit", 5))
    add("cases", opt("--limit", 3))
    add("risk", arg("type", nargs="?", default="person"), opt("--limit", 15))
    add("explain", arg("left"), arg("right"))
    add("demo")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        commands = Commands(args)
        return getattr(commands, "ontology_" if args.command == "ontology" else args.command)()
    except QueryError as error:
        print(f"error: {error}", file=sys.stderr)
        return 2
    except KeyboardInterrupt:
        return 130
