"""One run from the command line: ``python -m quillmesh FOLDER [--option value ...]``."""

from __future__ import annotations

import argparse
import typing
from dataclasses import fields

from quillmesh.config import CHOICES, Options


def parser() -> argparse.ArgumentParser:
    """An option for every setting, with the same names and defaults."""
    p = argparse.ArgumentParser("quillmesh", description=__doc__)
    p.add_argument("folder", nargs="?", help="folder of the parquet tables")
    p.add_argument("--master", help="master of the session, if none is running")
    p.add_argument("--output", help="where a trace of merges or a curve of thresholds is written")
    p.add_argument("--column-names", action="store_true", help="only print the names of a CSV report's columns")
    p.add_argument("--keep-log", action="store_true", help="go on with an old log file")
    types = typing.get_type_hints(Options)
    for f in fields(Options):
        flag = "--" + f.name.replace("_", "-")
        if types[f.name] is bool:
            p.add_argument(flag, action=argparse.BooleanOptionalAction, default=f.default)
            continue
        kind = next((t for t in typing.get_args(types[f.name]) if t is not type(None)), types[f.name])
        p.add_argument(flag, type=kind, default=f.default, help=", ".join(CHOICES.get(f.name, ())) or None)
    return p


def main(argv: list[str] | None = None) -> str:
    """Run and return what is printed."""
    from quillmesh.plans.runs import Run
    from quillmesh.session import log_to, session
    from quillmesh.sources.sinks import header

    a = parser().parse_args(argv)
    o = Options(**{f.name: getattr(a, f.name) for f in fields(Options)})
    if a.column_names:
        return header(o)
    if not a.folder:
        raise SystemExit("a folder is missing")
    log_to(o.debug, o.log_file, a.keep_log)
    return Run(session(master=a.master), a.folder, o).output(a.output)


if __name__ == "__main__":
    print(main())
