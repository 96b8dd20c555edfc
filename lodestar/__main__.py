"""python -m lodestar VERB ROOT [ARGUMENT...]: maintenance from the command line."""

from __future__ import annotations

import sys

from lodestar.plans.engine import Engine
from lodestar.session import get_session

VERBS = ["index-verify", "index-prune", "index-import", "verify-deep", "docs-verify", "docs-list", "docs-import", "docs-search", "docs-migrate", "docs-prune", "docs-repair", "search"]


def main(args: list[str]) -> int:
    if len(args) < 2 or args[0] not in VERBS:
        print(f"{__doc__}\nVerbs: {', '.join(VERBS)}", file=sys.stderr)
        return 2
    verb, root, *rest = args
    engine = Engine(get_session(), root)
    if verb == "index-verify":
        issues = [r for name in rest or engine.store.names() for r in engine.verify(name).collect()]
        for r in issues:
            print(f"{r['collection']}\t{r['kind']}\t{r['source']}\t{r['detail']}")
        return int(bool(issues))
    if verb == "index-prune":
        print(sum(engine.store.vacuum(name) for name in rest or engine.store.names()))
    elif verb == "index-import":
        known = set(engine.registry)
        for name in (n for n in engine.store.names() if n not in known and engine.store.read_manifest(n)):
            engine.registry.update_entry(name, chunks=engine.store.read_manifest(name)["chunks"])
            print(name)
    elif verb == "verify-deep":
        with open(rest[1], encoding="utf-8") as f:
            report = engine.verify_deep(rest[0], rest[1], f.read())
        print(report)
        return int(not report["ok"])
    elif verb == "docs-verify":
        print(engine.documents.read("vault").where("path is null or sha256 <> sha2(text, 256)").count())
    elif verb == "docs-list":
        engine.list_documents(limit=int(rest[0]) if rest else 50).select("path", "title").show(1000, False)
    elif verb == "docs-import":
        engine.documents_import(rest[0]).groupBy("status").count().show()
    elif verb == "docs-migrate":
        engine.documents_migrate(rest[0]).show(1000, False)
    elif verb == "docs-prune":
        print(engine.documents_prune(rest[0]))
    elif verb == "docs-repair":
        book = engine.documents.read("vault").selectExpr("sha256", "sha256 AS raw_sha256", "path", "updated_at", "substring(sha256, 1, 8) AS id")
        print(engine.repair_sources(rest[0], engine.store.read(rest[0]).selectExpr("source_file", "metadata['sha256'] AS sha256").distinct(), book))
    elif verb == "docs-search":
        hits, totals = engine.search_document(rest[0])
        hits.select("path", "line", "text").show(200, 120)
        print(totals)
    else:
        engine.search_memory(" ".join(rest)).select("score", "collection", "source", "text").show(50, 120)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
