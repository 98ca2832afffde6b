"""Command line: init, seed, run, validate, explain, diff."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from tidemill import diagnostics
from tidemill.errors import TidemillError
from tidemill.plans import evolve, rules
from tidemill.plans.compiler import compile_model, qualified
from tidemill.plans.project import PROJECT_FILE, SOURCES_FILE, load
from tidemill.runner import Backend, Runner, Session
from tidemill.sources.session import open_session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemill")
    sub = p.add_subparsers(dest="verb", required=True)
    for verb in ("init", "seed", "run", "validate", "explain", "diff"):
        s = sub.add_parser(verb)
        s.add_argument("--project-dir", default=".")
        s.add_argument("--target", default="dev")
        s.add_argument("--database", help="schema that models are written to")
        s.add_argument("--verbose", "-v", action="store_true")
        if verb == "run":
            s.add_argument("--show-results", action="store_true")
            s.add_argument("--dry-run", action="store_true")
            s.add_argument("--parallel", type=int, default=1)
            s.add_argument("--changed-only", action="store_true", help="leave models alone whose text and inputs are unchanged")
            s.add_argument("--no-optimize", action="store_true", help="compute shared subplans for each model")
        if verb in ("run", "explain"):
            s.add_argument("--select", nargs="*")
    return p


#: Files of a new project.
STARTER = {
    PROJECT_FILE: "name: {name}\nmodel_paths: [models]\ntargets:\n  dev:\n    type: spark\n    schema: main\ndefault_materialization: view\n",
    SOURCES_FILE: "sources:\n  raw:\n    tables:\n      events:\n        columns:\n          - {{name: event_id, type: INTEGER}}\n          - {{name: kind, type: VARCHAR}}\n",
    "seeds/setup.sql": "CREATE SCHEMA IF NOT EXISTS raw;\nCREATE TABLE IF NOT EXISTS raw.events (event_id INTEGER, kind VARCHAR);\nINSERT INTO raw.events VALUES (1, 'view'), (2, 'click');\n",
    "models/kinds.sql": "SELECT kind, count(*) AS n FROM mill.ref('raw.events') GROUP BY kind\n",
}


def init(folder: str) -> list[str]:
    """Writes the files of a small project that runs; files that are there stay."""
    root, out = Path(folder), []
    for name, text in STARTER.items():
        at = root / name
        if not at.exists():
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_text(text.format(name=root.resolve().name), encoding="utf-8")
            out.append(str(at))
    return out


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    try:
        return _run(args, spark)
    except TidemillError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def _run(args: argparse.Namespace, spark) -> int:
    if args.verb == "init":
        for f in init(args.project_dir):
            print(f"wrote {f}")
        return 0
    project = load(args.project_dir)
    if args.target not in project.targets:
        raise TidemillError(f"there is no target {args.target!r}; there are {', '.join(project.targets)}")
    target = project.targets[args.target]
    schema = args.database or target.schema
    if args.verb == "validate":
        found = diagnostics.validate(project)
        for d in found:
            print(f"{d.model}:{d.line + 1}:{d.column + 1}: {d.severity}: {d.message}")
        return int(any(d.severity == "error" for d in found))
    order = project.order()
    if args.verbose or getattr(args, "dry_run", False):
        print("order: " + ", ".join(order))
    if getattr(args, "dry_run", False):
        for m in order:
            c = compile_model(project, m, qualified(project, schema))
            print(f"-- {m} ({c.materialization})\n{c.sql}")
        return 0
    spark = spark or open_session(target)
    if args.verb == "seed":
        for f in sorted((project.root / "seeds").glob("*.sql")):
            Backend(spark, schema).script(f.read_text(encoding="utf-8"))
            print(f"ran {f.name}")
        return 0
    if args.verb == "run":
        results = Runner(spark, project, schema, parallel=args.parallel, optimize=not args.no_optimize, changed_only=args.changed_only).run(args.select or None, args.show_results)
        for r in results:
            print(f"{r.model}: {r.kind}, {r.seconds:.2f} s" + (f", {r.rows} rows" if r.rows is not None else ""))
            if r.preview is not None:
                r.preview.show(truncate=False)
        print(f"{len(results)} models, {sum(r.seconds for r in results):.2f} s")
        return 0
    session = Session(spark, project)
    frames = {m: session.frame(m) for m in order}
    if args.verb == "explain":
        for m in args.select or order:
            frames[m].explain("formatted")
        for p in rules.propose(frames):
            print(f"{p.rule} ({p.kind}): {', '.join(p.models)}: {p.benefit}")
        return 0
    for m in order:
        if spark.catalog.tableExists(f"{schema}.{m}"):
            for c in evolve.diff(spark.table(f"{schema}.{m}").schema, frames[m].schema):
                print(f"{m}: {c.kind} {c.column} {c.old or ''} {c.new or ''}".rstrip())
    return 0


if __name__ == "__main__":
    sys.exit(main())
