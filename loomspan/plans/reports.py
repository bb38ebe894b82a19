"""Text reports from one-row results. Numbers are formatted on the driver, where halves round as C and Python do."""

from __future__ import annotations

from pyspark.sql import DataFrame


def stats_report(stats: DataFrame) -> str:
    r = stats.first()
    # Fixed format.
    return (
        f"Genes                   : {r['n_genes']}\n"
        f"Transcripts             : {r['n_transcripts']}\n"
        f"Exons                   : {r['n_exons']}\n"
        f"Introns                 : {r['n_introns']}\n"
        f"Mean exons per gene     : {r['mean_exons_per_gene']:.2f}\n"
        f"Mean introns per gene   : {r['mean_introns_per_gene']:.2f}\n"
        f"Single-exon genes       : {r['n_single_exon_genes']} ({r['pct_single_exon_genes']:.1f}%)\n"
        f"Single-exon transcripts : {r['n_single_exon_transcripts']} ({r['pct_single_exon_transcripts']:.1f}%)\n"
    )


def compare_report(counts: DataFrame, introns: DataFrame, label1: str, label2: str) -> str:
    """From class_counts and intron_counts. A source without transcripts has no block; sensitivity and precision need both."""
    by = {r["src"]: r for r in counts.collect()}
    i = introns.first()
    line = lambda name, n, tail="": f"  {name:<26}: {n:>8}{tail}\n"
    out = f"Structural GTF comparison\n  GTF1 = {label1}\n  GTF2 = {label2}\n\n"
    for s in (1, 2):
        if r := by.get(s):
            n = r["n_tx"]
            out += f"=== Transcript classification (GTF{s}) ===\n" + line(f"GTF{s}", n)
            for name, k in (("Exact match      (=)", "n_exact"), ("Partial match    (j)", "n_partial"), ("Overlap only     (o)", "n_overlap"), ("Unique           (u)", "n_unique")):
                out += line(name, r[k], f"  ({100 * r[k] / n:5.1f}%)")
            out += "\n"
    out += "=== Intron-level ===\n" + line("GTF1 unique introns", i["n_introns_1"]) + line("GTF2 unique introns", i["n_introns_2"])
    if i["n_introns_1"] or i["n_introns_2"]:
        out += line("Shared", i["n_shared"], f"  ({i['pct_shared_1']:.1f}% of GTF1, {i['pct_shared_2']:.1f}% of GTF2)")
    out += "\n"
    if 1 in by and 2 in by:
        out += f"  Sensitivity (GTF1 exact / GTF1 total) : {100 * by[1]['n_exact'] / by[1]['n_tx']:.1f}%\n"
        out += f"  Precision   (GTF2 exact / GTF2 total) : {100 * by[2]['n_exact'] / by[2]['n_tx']:.1f}%\n"
    return out


def id_report(summary: DataFrame, label1: str, label2: str) -> str:
    """From identifiers.summary."""
    by = {r["level"]: r for r in summary.collect()}
    pct = lambda n, total: f"{100 * n / total:.1f}%" if total else "N/A"
    out = f"  GTF1 = {label1}\n  GTF2 = {label2}\n"
    for level, title in (("gene", "Gene-level"), ("transcript", "Transcript-level")):
        r = by[level]
        row = lambda name, n, tail="": f"  {name:<22}: {n:>10,}{tail}\n"
        out += f"\n=== {title} comparison ===\n" + row("GTF1", r["n1"]) + row("GTF2", r["n2"])
        out += row("Shared", r["shared"], f"  ({pct(r['shared'], r['n1'])} of GTF1, {pct(r['shared'], r['n2'])} of GTF2)")
        out += row("Only in GTF1", r["only1"], f"  ({pct(r['only1'], r['n1'])} of GTF1)") + row("Only in GTF2", r["only2"], f"  ({pct(r['only2'], r['n2'])} of GTF2)")
    return out


def venn_sizes(summary: DataFrame) -> dict[str, tuple[int, int, int]]:
    """For each level the sizes of the three regions: only first, only second, both."""
    return {r["level"]: (r["only1"], r["only2"], r["shared"]) for r in summary.collect()}


def venn(summary: DataFrame, path: str, label1: str, label2: str) -> bool:
    """One diagram for each level, below each other; False, and nothing written, where the plot library is missing."""
    try:
        from matplotlib.figure import Figure
        from matplotlib_venn import venn2
    except ImportError:
        return False
    sizes = venn_sizes(summary)
    figure = Figure(figsize=(6, 5 * len(sizes)), layout="constrained")
    for place, (level, regions) in enumerate(sorted(sizes.items()), 1):
        panel = figure.add_subplot(len(sizes), 1, place)
        venn2(regions, (label1, label2), ax=panel)
        panel.set_xlabel(f"{level} ids: {sum(regions):,}")
    figure.savefig(path)
    return True
