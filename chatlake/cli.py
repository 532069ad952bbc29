"""Command line: ``python -m chatlake.cli parse|export|chain``.

Exit codes: 2 a path is missing or of the wrong kind, 3 no permission, 4 no parsed threads, 99 any other failure.
"""

from __future__ import annotations

import argparse
import logging
import os
import sys
from pathlib import Path
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from chatlake import i18n, pipeline
from chatlake.i18n import t
from chatlake.operators.split import SplitSpec
from chatlake.session import build_session

log = logging.getLogger("chatlake")


def setup_logger(level: str | None = None) -> logging.Logger:
    """Log to standard output as ``[LEVEL] text``; the level is given, or CHATLAKE_LOGLEVEL, or INFO."""
    logging.basicConfig(stream=sys.stdout, format="[%(levelname)s] %(message)s", force=True)
    log.setLevel((level or os.environ.get("CHATLAKE_LOGLEVEL") or "INFO").upper())
    return log


def checked_path(path: str, *, must_exist: bool = True, file: bool = False, folder: bool = False) -> str:
    p = Path(path)
    if must_exist and not p.exists():
        raise FileNotFoundError(t("missing", path=path))
    if p.exists() and (file and not p.is_file() or folder and not p.is_dir()):
        raise NotADirectoryError(t("missing", path=path))
    return path


def time_zone(name: str) -> str:
    """``name`` if it is a time zone, else UTC with a warning."""
    try:
        ZoneInfo(name)
        return name
    except (ZoneInfoNotFoundError, ValueError, OSError):
        log.warning(t("unknown_tz", tz=name))
        return "UTC"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("chatlake", description=t("description"))
    p.add_argument("--locale")
    p.add_argument("--log-level")
    p.add_argument("--master")
    sub = p.add_subparsers(dest="command", required=True)

    def common(q):
        q.add_argument("--tz", default="UTC", help=t("tz"))
        q.add_argument("--formatting", choices=["none", "light"], default="light", help=t("formatting"))
        q.add_argument("--split", help=t("split"))
        q.add_argument("--split-soft-overflow", type=float, default=0.20)
        q.add_argument("--split-hard", action="store_true")
        q.add_argument("--split-preview", action="store_true")
        q.add_argument("--tiny-tail-threshold", type=int, default=20)

    def reading(q, required):
        q.add_argument("--provider", default="openai", help=t("provider"))
        q.add_argument("--input", required=required, help=t("input"))
        q.add_argument("--outdir", default="artifacts", help=t("outdir"))
        q.add_argument("--dry-run", action="store_true", help=t("dry_run"))
        q.add_argument("--fail-fast", action="store_true", help=t("fail_fast"))
        q.add_argument("--validate-schema", action="store_true")
        q.add_argument("--decide-by", choices=["count", "time"], default="count")

    reading(sub.add_parser("parse", help=t("parse")), True)
    e = sub.add_parser("export", help=t("export"))
    e.add_argument("--input", required=True, help=t("input"))
    e.add_argument("--outdir", required=True, help=t("outdir"))
    common(e)
    c = sub.add_parser("chain", help=t("chain"))
    reading(c, False)
    c.add_argument("--parsed-root")
    c.add_argument("--export-outdir")
    common(c)
    for name in ("viewer", "config"):
        sub.add_parser(name, help=t("viewer"))
    return p


def run(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    i18n.set_locale(argv[argv.index("--locale") + 1] if "--locale" in argv[:-1] else None)
    a = parser().parse_args(argv)
    setup_logger(a.log_level)
    if a.command in ("viewer", "config"):
        log.info(t("viewer"))
        return 0
    try:
        spec = SplitSpec.parse(a.split, soft_overflow=a.split_soft_overflow, hard=a.split_hard, tiny_tail=a.tiny_tail_threshold) if a.command != "parse" else None
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    try:
        if getattr(a, "input", None):
            checked_path(a.input)
        if getattr(a, "parsed_root", None) and not Path(a.parsed_root).is_dir():
            log.error(t("missing", path=a.parsed_root))
            return 4
        spark = build_session(master=a.master)
        if a.command == "parse":
            r = pipeline.parse(spark, a.provider, a.input, a.outdir, dry_run=a.dry_run, fail_fast=a.fail_fast, validate_schema=a.validate_schema, decide_by=a.decide_by)
            log.info(t("parsed", threads=r.threads, messages=r.messages, errors=r.errors, skipped=r.skipped))
        elif a.command == "export":
            r = pipeline.export(spark, a.input, a.outdir, tz=time_zone(a.tz), formatting=a.formatting, spec=spec, preview=a.split_preview)
            log.info(t("exported", files=len(r.paths), errors=r.errors))
        else:
            first, r = pipeline.chain(spark, a.provider, a.input, a.outdir, parsed_root=a.parsed_root, export_outdir=a.export_outdir, dry_run=a.dry_run, tz=time_zone(a.tz), formatting=a.formatting, spec=spec, fail_fast=a.fail_fast, validate_schema=a.validate_schema, decide_by=a.decide_by)
            log.info(t("parsed", threads=first.threads, messages=first.messages, errors=first.errors, skipped=first.skipped))
            log.info(t("exported", files=len(r.paths), errors=r.errors))
        return 0
    except PermissionError as e:
        log.error(e)
        return 3
    except (FileNotFoundError, NotADirectoryError) as e:
        log.error(e)
        return 2
    except Exception as e:  # noqa: BLE001 - the code tells the caller
        log.error("%s: %s", type(e).__name__, e)
        return 99


if __name__ == "__main__":
    sys.exit(run())
