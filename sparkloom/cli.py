"""Commands over a project folder: ``python -m sparkloom.cli COMMAND FOLDER``."""

from __future__ import annotations

import argparse
import json
import platform
import sys
from importlib import metadata

COMMANDS = ("init", "brief", "intake", "resolve", "migrate", "extract", "reconcile", "synthesise", "session", "finish", "queue", "follow", "check-intake", "check-claims", "index", "candidates", "check-decisions", "plan", "check-master", "audit", "export", "seal", "status", "doctor")


def versions() -> dict[str, str | None]:
    """The versions of what the engine stands on; null where it isn't installed."""
    found = {"python": platform.python_version()}
    for name in ("pyspark", "pyarrow", "pandas", "numpy", "PyYAML", "tiktoken"):
        try:
            found[name] = metadata.version(name)
        except metadata.PackageNotFoundError:
            found[name] = None
    return found


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sparkloom", description=__doc__)
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("folder")
    p.add_argument("files", nargs="*", help="intake: the files to take in; queue: the directive; brief: the topic; finish: the session")
    p.add_argument("--only", help="resolve: targets that contain this")
    p.add_argument("--source", action="append", default=[], help="resolve: scan this source")
    p.add_argument("--force", action="store_true", help="synthesise: replace an edited master")
    p.add_argument("--dry-run", action="store_true")
    a = p.parse_args(argv)
    from sparkloom.plans.stages import Project, messages
    from sparkloom.session import local_session
    from sparkloom.sources.files import http_get, log_run
    from sparkloom.streaming.control import Queue

    if a.command == "doctor":
        print(json.dumps(versions(), indent=2))
        return 0
    project = Project(local_session(), a.folder)
    gates = {"check-intake": project.check_intake, "check-claims": project.check_claims, "check-decisions": project.check_decisions, "check-master": project.check_master, "audit": project.check_audit}
    ok, out = True, None
    try:
        if a.command in gates:
            out = gates[a.command](dry_run=a.dry_run)
            ok = out["status"] == "PASS"
            out = {"messages": messages(out)} | {k: v for k, v in out.items() if k not in ("reasons", "warnings")}
        elif a.command == "extract":
            out = project.extract(dry_run=a.dry_run)
        elif a.command == "reconcile":
            out = project.reconcile(dry_run=a.dry_run)
            ok = out["gate"]["status"] == "PASS"
        elif a.command in ("session", "finish", "queue", "follow"):
            queue = Queue(project.root / "index" / "control")
            out = {"session": queue.start, "finish": lambda: queue.finish(*a.files[:1]), "queue": lambda: queue.put(" ".join(a.files)), "follow": lambda: queue.follow(project.spark)}[a.command]()
        elif a.command in ("intake", "resolve", "migrate"):
            if a.command == "intake":
                out = project.intake(a.files, dry_run=a.dry_run)
            elif a.command == "resolve":
                out = project.resolve(http_get, only=a.only, source_ids=a.source, dry_run=a.dry_run)
            else:
                out = project.migrate(dry_run=a.dry_run)
            ok = out["gate"]["status"] == "PASS" or a.command == "migrate" and a.dry_run
        elif a.command == "synthesise":
            out = project.synthesise(force=a.force, dry_run=a.dry_run)
        elif a.command == "brief":
            out = project.brief(" ".join(a.files), dry_run=a.dry_run)
        elif a.command == "init":
            out = project.init(project.root.name)
        elif a.command == "index":
            out = project.claims_index()
        elif a.command == "candidates":
            out = [r.asDict() for r in project.candidates().collect()]
        elif a.command == "plan":
            out = project.plan()
        elif a.command == "export":
            out = project.export(dry_run=a.dry_run)
        elif a.command == "seal":
            out = project.seal()
        else:
            out = project.status()
    except (RuntimeError, ValueError) as e:
        ok, out = False, str(e)
    log_run(project.root, a.command, ok)
    print(out if isinstance(out, str) else json.dumps(out, indent=2, default=str))
    return 0 if ok else 1


if __name__ == "__main__":
    sys.exit(main())
