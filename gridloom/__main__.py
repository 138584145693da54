"""``python -m gridloom FOLDER TARGET.xlsx`` converts PDF files; ``--self-test`` reports on the installation."""

from __future__ import annotations

import argparse
from pathlib import Path


def main() -> int:
    parser = argparse.ArgumentParser(prog="gridloom", description=__doc__)
    parser.add_argument("folder", nargs="?")
    parser.add_argument("target", nargs="?", type=Path)
    parser.add_argument("--options", type=Path, help="JSON file with options of the run")
    parser.add_argument("--engine", help="name of a registered OCR engine; without one, pages that need OCR are named and left out")
    parser.add_argument("--self-test", action="store_true")
    parser.add_argument("--output", type=Path, help="file for the report of --self-test")
    args = parser.parse_args()
    if args.self_test:
        from gridloom.doctor import self_test

        return self_test(args.output)
    if not args.folder:
        parser.error("a folder of PDF files is needed")
    from gridloom.plans import routing
    from gridloom.session import local_session

    spark = local_session()
    options = routing.Options.load(args.options) if args.options else routing.Options()
    run, refused = routing.convert_pdfs(spark, args.folder, options, engine=args.engine)
    target = run.export(args.target or Path(args.folder).with_suffix(".xlsx"))
    for r in refused.toLocalIterator():
        print(f"{r['source_file']}: {r['reason']}")
    for r in run.warnings.where("code IN ('OCR_UNAVAILABLE', 'RENDER_FAILED')").toLocalIterator():
        print(f"{r['source_file']}, page {r['page_number']}: {r['code']}: {r['message']}")
    print(target)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
