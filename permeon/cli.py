"""Command lines: `python -m permeon.cli glm ..` and `python -m permeon.cli similarity ..`, to be run by spark-submit as well."""

from __future__ import annotations

import argparse
import difflib
import json
import os
import sys
import warnings

from pyspark.sql import SparkSession

from .plans.facade import Dataset, spatial_similarity
from .sources import loaders, sinks

TABLES = (".csv", ".tsv", ".txt", ".npy")
MATRICES = (*TABLES, ".con", ".mat")
#: Flags of the command line that this one follows which have no meaning here; they are told and left out.
IGNORED = """
-s -npcmethod -npcmod -npccon -npc -mv -C -Cstat -tfce1D -tfce2D -corrmod -concordant -reversemasks -advanced -con -tonly -cmcp -cmcx
-conskipcount -Cuni -Cnpc -Cmv -designperinput -ev4vg -evperdat -inormal -probit -inputmv -noranktest -noniiclass -nounivariate
-nouncorrected -pmethodp -pmethodr -removevgbysize -rmethod -savedof -savemask -savemetrics -saveparametric -saveglm -syncperms -subjidx
-tfce_H -tfce_E -tfce_dh -Tuni -Tnpc -Tmv -transposedata -verbosefilenames -vgdemean
""".split()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="permeon", description=__doc__)
    sub = p.add_subparsers(dest="what", required=True)
    g = sub.add_parser("glm", help="permutation analysis of one dataset")
    g.add_argument("-i", dest="data", nargs="+", required=True, help="a table, or images")
    g.add_argument("-d", dest="design", required=True)
    g.add_argument("-t", dest="contrast", required=True)
    g.add_argument("-f", dest="f_contrast", help="which contrasts the F-test joins")
    g.add_argument("-fonly", dest="f_only", action="store_true")
    g.add_argument("-eb", dest="exchangeability")
    g.add_argument("-vg", dest="vg", help="variance groups, or 'auto'")
    g.add_argument("-within", action="store_true", default=None)
    g.add_argument("-whole", action="store_true", default=None)
    g.add_argument("-ise", dest="flip_signs", action="store_true", help="flip signs besides permuting")
    g.add_argument("-n", dest="permutations", type=int, default=1000)
    g.add_argument("-seed", type=int, default=42)
    g.add_argument("-m", dest="mask")
    g.add_argument("-o", dest="output", default="permeon")
    g.add_argument("-T", dest="tfce", action="store_true")
    g.add_argument("-demean", action="store_true")
    g.add_argument("-zstat", action="store_true")
    g.add_argument("-pearson", action="store_true")
    g.add_argument("-twotail", action="store_true")
    g.add_argument("-accel", choices=["tail"], help="fit the tail of the null maxima")
    g.add_argument("-corrcon", action="store_true", help="correct across contrasts")
    g.add_argument("-save1-p", dest="one_minus_p", action="store_true")
    g.add_argument("-logp", dest="neg_log10_p", action="store_true")
    g.add_argument("-saveperms", action="store_true")
    s = sub.add_parser("similarity", help="similarity of datasets' maps")
    s.add_argument("-configs", nargs="+", required=True, help="datasets as saved by Dataset.save_config")
    s.add_argument("-refs", nargs="*", default=[], help="reference maps: tables or images")
    s.add_argument("-n", dest="permutations", type=int)
    s.add_argument("-m", dest="mask")
    s.add_argument("-twotail", action="store_true")
    s.add_argument("-accel", action="store_true")
    s.add_argument("-o", dest="output", required=True)
    return p


def left_out(rest: list[str], known: argparse.ArgumentParser) -> list[str]:
    """Of the arguments that the parser doesn't know, those to be ignored; anything else is an error."""
    told, values = [], False
    for arg in rest:
        flag = arg.startswith("-") and not arg[1:2].isdigit()
        if flag and arg not in IGNORED:
            near = difflib.get_close_matches(arg, [*IGNORED, *(o for a in known._actions for o in a.option_strings)], 1)
            known.error(f"unknown flag {arg}" + (f"; did you mean {near[0]}?" if near else ""))
        if not flag and not values:
            known.error(f"unknown argument {arg}")
        values = values or flag
        told.append(arg)
    return told


def output_prefix(given: str) -> str:
    """A folder gives a prefix inside it; anything else is a prefix, relative to the current folder; URIs stay as they are."""
    if "://" in given:
        return given
    path = os.path.abspath(given)
    if given.endswith(os.sep) or os.path.isdir(path):
        os.makedirs(path, exist_ok=True)
        return os.path.join(path, "")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    return path


def checked(args: argparse.Namespace) -> argparse.Namespace:
    """Settings that don't go together."""
    if args.what != "glm":
        return args
    images = loaders.is_image(args.data)
    if not images and (len(args.data) != 1 or loaders.suffix_of(args.data[0]) not in TABLES):
        raise SystemExit(f"-i: a table ({', '.join(TABLES)}) or images")
    for name in ("design", "contrast", "f_contrast", "exchangeability"):
        value = getattr(args, name)
        if value and loaders.suffix_of(value) not in MATRICES:
            raise SystemExit(f"{name}: one of {', '.join(MATRICES)}")
    if args.f_only and not args.f_contrast:
        raise SystemExit("-fonly needs -f")
    if args.tfce and not args.mask and not images:
        raise SystemExit("-T needs images or -m")
    if args.permutations <= 0:
        raise SystemExit("-n must be positive")
    if args.one_minus_p and args.neg_log10_p:
        warnings.warn("-save1-p wins over -logp", stacklevel=2)
        args.neg_log10_p = False
    return args


def glm(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    settings = {
        k: getattr(a, k)
        for k in ("design", "contrast", "f_contrast", "f_only", "exchangeability", "within", "whole", "flip_signs", "permutations", "seed", "tfce", "demean", "zstat", "one_minus_p", "neg_log10_p")
    } | {"two_tailed": a.twotail, "accel_tail": a.accel == "tail", "across_contrasts": a.corrcon, "return_permutations": a.saveperms}
    if a.pearson:
        settings |= {"stat": "pearson", "f_stat": "pearson"}
    if a.vg == "auto":
        settings["vg_auto"] = True
    elif a.vg:
        settings["variance_groups"] = a.vg
    data = Dataset(a.data if loaders.is_image(a.data) else a.data[0], settings, a.mask, a.output)
    data.save_config(spark, f"{a.output}_config.json", sys.argv)
    out = data.run(spark)
    if a.saveperms:
        sinks.save_permutations(out["permuted_stats"], a.output)
    if "tfce" in out:
        sinks.save_parquet(out["tfce"], f"{a.output}_tfce", "overwrite")
    return out["files"]


def similarity(spark: SparkSession, a: argparse.Namespace) -> None:
    datasets = []
    for i, path in enumerate(a.configs):
        d = Dataset.from_config(spark, path)
        d.name = f"{d.name}{i}"
        if a.permutations:
            d.settings["permutations"] = a.permutations
        d.mask = a.mask or d.mask
        datasets.append(d)
    volume = datasets[0].volume(spark)
    refs = {}
    for path in a.refs:
        refs[path] = loaders.read_volume(spark, path).data[volume.data != 0] if loaders.is_image(path) else loaders.read_matrix(spark, path)
    sinks.save_similarity(spark, spatial_similarity(spark, datasets, refs or None, a.twotail, None, a.accel), a.output)


def main(argv: list[str] | None = None) -> int:
    known = parser()
    args, rest = known.parse_known_args(argv)
    which = next(a for a in known._actions if isinstance(a, argparse._SubParsersAction)).choices[args.what]
    if ignored := left_out(rest, which):
        warnings.warn(f"ignored: {' '.join(ignored)}", stacklevel=2)
    args = checked(args)
    args.output = output_prefix(args.output)
    spark = SparkSession.builder.appName("permeon").getOrCreate()
    if args.what == "glm":
        print(json.dumps(glm(spark, args)))
    else:
        similarity(spark, args)
    return 0


def glm_main() -> int:
    """The console script of the analysis."""
    return main(["glm", *sys.argv[1:]])


def similarity_main() -> int:
    """The console script of the similarity of maps."""
    return main(["similarity", *sys.argv[1:]])


if __name__ == "__main__":
    sys.exit(main())
