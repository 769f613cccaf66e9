"""Command line: one JSON object per line; exit codes 0 (rows), 1 (error), 2 (nothing found, or usage)."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .engine import Engine, ModelMismatch, NotFound
from .functions import constants as C


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="chronofold")
    p.add_argument("--pretty", action="store_true")
    p.add_argument("--home")
    sub = p.add_subparsers(dest="command", required=True)
    x = sub.add_parser("remember")
    x.add_argument("text")
    for name in ("key", "kind", "entity", "source"):
        x.add_argument(f"--{name}")
    x.add_argument("--confidence", choices=C.LEVELS, default="low")
    x = sub.add_parser("recall")
    x.add_argument("text")
    x.add_argument("-k", type=int, default=5)
    x.add_argument("--deep", action="store_true")
    x = sub.add_parser("log")
    x.add_argument("text", nargs="?")
    for name in ("topic", "entity", "since", "until"):
        x.add_argument(f"--{name}")
    x = sub.add_parser("query", aliases=["list"])
    x.add_argument("--entity")
    x.add_argument("--kind")
    x.add_argument("--status", default="active", choices=["active", "superseded", "forgotten", "all"])
    x.add_argument("--min-confidence", type=float)
    x = sub.add_parser("context")
    x.add_argument("text")
    x.add_argument("--budget", type=int, default=C.CONTEXT_BUDGET)
    x = sub.add_parser("profile")
    x.add_argument("--budget", type=int, default=C.PROFILE_BUDGET)
    x.add_argument("--write", action="store_true")
    for name in ("correct", "restate"):
        x = sub.add_parser(name)
        x.add_argument("id")
        x.add_argument("text")
    for name in ("show", "restore"):
        sub.add_parser(name).add_argument("id")
    x = sub.add_parser("forget")
    x.add_argument("id")
    x.add_argument("--hard", action="store_true")
    sub.add_parser("status")
    sub.add_parser("reindex")
    sub.add_parser("compact")
    x = sub.add_parser("import")
    x.add_argument("path")
    x.add_argument("--strict", action="store_true")
    sub.add_parser("sleep").add_argument("--dry-run", action="store_true")
    return p


def answer(engine: Engine, a: argparse.Namespace) -> list[dict]:
    """Rows that a command prints."""
    match a.command:
        case "remember":
            return [engine.remember(a.text, a.key, a.kind, a.entity, a.source, a.confidence)]
        case "recall":
            return engine.recall(a.text, a.k, a.deep)
        case "log":
            return [engine.log_write(a.text, a.topic, a.entity)] if a.text is not None else engine.log_query(a.since, a.until, a.topic, a.entity)
        case "query" | "list":
            return engine.query(entity=a.entity, kind=a.kind, status=a.status, min_confidence=a.min_confidence)
        case "context":
            got = engine.context(a.text, a.budget)
            return [got] if got["items"] else []
        case "profile":
            got = engine.profile(a.budget, a.write)
            return [got] if got["items"] else []
        case "correct" | "restate":
            return [getattr(engine, a.command)(a.id, a.text)]
        case "show" | "restore":
            return [getattr(engine, a.command)(a.id)]
        case "forget":
            return [engine.forget(a.id, a.hard)]
        case "reindex":
            return [{"indexed": engine.reindex()}]
        case "compact":
            return [{"compacted": engine.compact()}]
        case "import":
            return [{"imported": engine.import_log(a.path, a.strict)}]
        case "sleep":
            got = engine.sleep(a.dry_run)
            return [got] if any(got[x] for x in ("merge_suggestions", "forget_candidates", "near_duplicates", "review_pairs", "episodic_candidates")) else []
    return [engine.status()]


def cut(text: str | None, n: int = 60) -> str:
    return (text or "")[:n]


def _report(row: dict) -> list[str]:
    lines = [f"# {'preview' if row['dry_run'] else 'done'}: {len(row['forget_candidates'])} to forget, {len(row['near_duplicates'])} to merge"]
    lines += [f"cluster {c['entity']}: {c['count']}" + "".join(f"\n    {x['id']}  {cut(x['text'])}" for x in c["claims"]) for c in row["merge_suggestions"]]
    lines += [f"forget {c['id']}  retention {c['retention']}  idle {c['days_idle']} days  {cut(c['text'], 50)}" for c in row["forget_candidates"]]
    lines += [f"merge {m['merged']} into {m['kept']}  ({m['score']})" for m in row["near_duplicates"]]
    lines += [f"review {p['a']['id']} {p['b']['id']}  ({p['score']})\n    {cut(p['a']['text'])}\n    {cut(p['b']['text'])}" for p in row["review_pairs"]]
    lines += [f"recent {e['ep']['id']}  {cut(e['ep']['text'], 50)}" + (f"\n    near {e['best_match']['id']}  ({e['best_match']['score']})  {cut(e['best_match']['text'], 40)}" if e["best_match"] else "") for e in row["episodic_candidates"]]
    return lines + ([f"report: {row['report_file']}"] if "report_file" in row else [])


def pretty(row: dict) -> str:
    if "items" in row:
        mark = lambda i: f"{i['score']:.4f}  " if "score" in i else f"({i['confidence']}, {i['hits']} hits)  "
        head = f"# {row.get('task', 'profile')}  ({row['used_tokens']} of {row['budget']} tokens)"
        return "\n".join([head, *(f"- {mark(i)}[{i['kind'] or ''}|{i['entity'] or ''}] {i['text']}" for i in row["items"])])
    if "forget_candidates" in row:
        return "\n".join(_report(row))
    if "score" in row and "text" in row:
        return f"{row['score']:.4f}  {row.get('id', '')}  {row['text']}"
    if "id" in row and "text" in row:
        return f"{row['id']}  [{row.get('kind') or ''}|{row.get('entity') or ''}] {row['text']}"
    return json.dumps(row, ensure_ascii=False, indent=2)


def main(argv: list[str] | None = None, engine: Engine | None = None) -> int:
    a = parser().parse_args(argv)
    if engine is None:
        engine = Engine(SparkSession.builder.appName("chronofold").config("spark.sql.session.timeZone", "UTC").getOrCreate(), a.home)
    try:
        rows = answer(engine, a)
        for row in rows:
            print(pretty(row) if a.pretty else json.dumps(row, ensure_ascii=False))
    except (ModelMismatch, NotFound, ValueError) as e:
        print(json.dumps({"error": str(e)}, ensure_ascii=False), file=sys.stderr)
        return 1
    except BrokenPipeError:
        return 0
    return 0 if rows else 2


if __name__ == "__main__":
    sys.exit(main())
