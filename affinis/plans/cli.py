"""affinis estimate | run: settings as options, results as paths, errors as JSON on stderr."""

from __future__ import annotations

import argparse
import json
import os
import sys

from affinis.config import Execution, Limits
from affinis.errors import AffinisError, CheckpointMismatchError, ConfigurationError, InputValidationError, OutputDirectoryConflictError, ResourceLimitError
from affinis.functions.codecs import CODECS, DEFAULT

#: Exit codes by the first class that an error is of.
EXIT = ((ConfigurationError, 2), (InputValidationError, 2), (ResourceLimitError, 3), (OutputDirectoryConflictError, 5), (CheckpointMismatchError, 5), (AffinisError, 4))
_INT = ("compression-level", "ppmd-order", "ppmd-memory-bytes", "bzip2-block-size-100k", "lzma-dictionary-bytes")


def parser() -> argparse.ArgumentParser:
    limits = Limits()
    top = argparse.ArgumentParser(prog="affinis", description="Group objects by the information they share.")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("estimate", "run"):
        p = commands.add_parser(name)
        p.add_argument("source", nargs="+", help="a dataset, or files and folders with --source files")
        p.add_argument("--source", dest="source_kind", choices=("delimited", "xlsx", "files"), default="delimited")
        p.add_argument("--split", choices=("columns", "rows"))
        for option in ("delimiter", "encoding", "sheet"):
            p.add_argument(f"--{option}")
        p.add_argument("--no-recursive", dest="recursive", action="store_const", const=False)
        p.add_argument("--include-hidden", action="store_const", const=True)
        p.add_argument("--workers", type=int)
        p.add_argument("--compressor", choices=tuple(CODECS), default=DEFAULT.name)
        for option in _INT:
            p.add_argument(f"--{option}", type=int)
        for option in ("max-objects", "max-pairs", "max-matrix-bytes", "max-working-memory-bytes"):
            p.add_argument(f"--{option}", type=int, default=getattr(limits, option.replace("-", "_")))
        p.add_argument("--max-pair-window-factor", type=float, default=limits.max_pair_window_factor)
        p.add_argument("--keep-normalized", action="store_true")
        p.add_argument("--save-diagnostics", action="store_true")
        if name == "estimate":
            p.add_argument("--json", action="store_true", help="one JSON document on stdout")
        else:
            p.add_argument("--clusters", type=int)
            p.add_argument("--output-dir")
            p.add_argument("--no-progress", action="store_true")
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    from affinis.plans import run as R

    own = {k.replace("-", "_"): getattr(a, k.replace("-", "_")) for k in _INT}
    given = {**own, **{k: getattr(a, k) for k in ("source_kind", "split", "delimiter", "encoding", "sheet", "recursive", "include_hidden", "compressor", "save_diagnostics")}}
    try:
        limits = Limits(a.max_objects, a.max_pairs, a.max_matrix_bytes, a.max_working_memory_bytes, max_pair_window_factor=a.max_pair_window_factor)
        execution = Execution(workers=a.workers if a.workers is not None else "auto", limits=limits)
        source = a.source if a.source_kind == "files" else a.source[0] if len(a.source) == 1 else a.source
        if a.command == "estimate":
            text = json.dumps(R.estimate(source, execution=execution, **given).to_json(), indent=2, sort_keys=True)
            print(text, file=sys.stdout if a.json else sys.stderr)
            return 0
        show = None if a.no_progress else lambda done, total, what: print(f"{what}: {done} of {total}", file=sys.stderr)
        result = R.run(source, output_dir=a.output_dir, num_clusters=a.clusters, keep_normalized=a.keep_normalized, execution=execution, progress=show, **given)
        print(result.run_dir)
        return 0
    except AffinisError as e:
        context = {k: v for k, v in e.context.items() if isinstance(v, (str, int, float, dict, list))}
        print(json.dumps({"error": {"code": e.code, "message": str(e), "context": context}}, sort_keys=True), file=sys.stderr)
        return next(code for kind, code in EXIT if isinstance(e, kind))
    except KeyboardInterrupt:
        return 130
    except BrokenPipeError:
        os.dup2(os.open(os.devnull, os.O_WRONLY), sys.stdout.fileno())
        return 141


if __name__ == "__main__":
    sys.exit(main())
