"""Commands for silos: compile, dump, export, query, query-file."""

from __future__ import annotations

import argparse
import sys
import time

from .operators.paths import query
from .schema import TreeError
from .silo import Silo
from .sources.builder import Builder, Rules, Source
from .sources.xml import system_locales


def _parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="silvestra", description=__doc__)
    out.add_argument("--force", action="store_true", help="compile even if nothing changed")
    out.add_argument("--wait", action="store_true", help="after compile, keep watching the sources")
    out.add_argument("--profile", action="store_true", help="print how long queries took")
    out.add_argument("--tokenize", action="store_true", help="store tokens for word search")
    out.add_argument("--verbose", action="store_true", help="explain plans")
    sub = out.add_subparsers(dest="command", required=True)
    for name, words in (("compile", ["silo", "files+"]), ("dump", ["silos+"]), ("export", ["silo"]), ("query", ["silo", "xpath", "limit?"]), ("query-file", ["silo", "file"])):
        one = sub.add_parser(name)
        for w in words:
            one.add_argument(w.rstrip("+?"), **({"nargs": w[-1]} if w[-1] in "+?" else {}))
    return out


def _show(silo: Silo, rows) -> int:
    found = silo.export(rows, multiline=True, indent=True).collect()
    for r in found:
        print(r["xml"], end="")
    return 0 if found else 1


def main(args: list[str] | None = None, spark=None) -> int:
    """The exit code; 1 where nothing is found or something fails."""
    a = _parser().parse_args(args)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("silvestra").getOrCreate()
    try:
        if a.command == "compile":
            while True:
                builder = Builder(spark)
                for locale in system_locales():
                    builder.add_locale(locale)
                for path in a.files:
                    builder.add_source(Source.of_file(path))
                rules = Rules(literal=True, native_langs=True, ignore_invalid=True, tokenize=a.tokenize)
                silo = Silo.ensure(builder, a.silo, rules) if not a.force else Silo(builder.compiled(rules), builder.guid()).save(a.silo)
                if not a.wait:
                    return 0
                while builder.guid() == silo.guid:
                    time.sleep(1)
        if a.command == "dump":
            for path in a.silos:
                print(Silo.load(spark, path).dump())
            return 0
        silo = Silo.load(spark, a.silo)
        silo.profile = [] if a.profile else None
        if a.command == "export":
            print(silo.export_text(header=True, multiline=True, indent=True), end="")
            return 0
        if a.command == "query":
            rows = silo.run(a.xpath, limit=int(a.limit or 0), ordered=True)
            code = _show(silo, rows)
        else:
            code = 0
            with open(a.file) as lines:
                for xpath in filter(None, map(str.strip, lines)):
                    n = query(silo.nodes, xpath).check().rows.count()
                    print(f"{xpath}: {n}")
                    code = code or int(n == 0)
        if a.verbose and a.command == "query":
            rows.explain("formatted")
        if a.profile:
            print(silo.profile_text(), file=sys.stderr)
        return code
    except TreeError as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
