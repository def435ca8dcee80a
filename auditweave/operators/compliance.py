"""Compliance dimensions and the register that joins findings to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASVS 5.0.0 chapters.
ASVS_CHAPTERS = {
    "V1": "Encoding and Sanitization", "V2": "Validation and Business Logic", "V3": "Web Frontend Security", "V4": "API and Web Service", "V5": "File Handling", "V6": "Authentication",
    "V7": "Session Management", "V8": "Authorization", "V9": "Self-contained Tokens", "V10": "OAuth and OIDC", "V11": "Cryptography", "V12": "Secure Communication", "V13": "Configuration",
    "V14": "Data Protection", "V15": "Secure Coding and Architecture", "V16": "Security Logging and Error Handling", "V17": "WebRTC",
}
#: The weaknesses (CWE numbers) that each chapter's controls prevent.
ASVS_WEAKNESSES = {
    "V1": (89, 78, 79, 94, 98, 95, 1336, 611, 943),
    "V2": (20, 915, 1321, 918, 400, 841, 602),
    "V3": (601, 942, 1004, 614, 1275, 352),
    "V5": (22, 434),
    "V6": (287,),
    "V7": (384,),
    "V8": (639, 284, 732, 862),
    "V9": (347,),
    "V11": (327, 338, 330, 321, 311, 916),
    "V12": (295, 319),
    "V13": (798, 250, 489, 552, 668, 16),
    "V14": (1021, 693),
    "V15": (502, 1104, 1395, 494, 1357, 749, 758, 704),
    "V16": (209, 532),
}
#: PCI DSS 4.0.1 requirements and the weaknesses that bear on them.
PCI_WEAKNESSES = {
    "6.2.4": (89, 78, 79, 94, 95, 1336, 611, 943, 502, 352, 20, 915, 1321, 918, 400, 601, 942, 1004, 614, 1275, 22, 98, 434, 287, 384, 347, 639, 284, 732, 862, 841, 602, 306, 693, 1021, 327, 338, 330, 916, 295, 319, 749, 758, 704),
    "8.6.2": (798, 321),
    "6.3.1": (1395, 1104, 1357, 494),
}
#: Weaknesses for which no requirement is asserted, since it would depend on the data or the environment.
PCI_REFUSED = ("CWE-311", "CWE-209", "CWE-532", "CWE-16", "CWE-250", "CWE-489", "CWE-552", "CWE-668", "CWE-Other")
#: CRA clauses.
CRA_ALWAYS = ("Annex I Part I (2)(a)", "Annex I Part II (2)")
CRA_DEPENDENCY = "Annex I Part II (1)"
CRA_DEFAULTS, CRA_DEFAULTS_CWES = "Annex I Part I (2)(b)", ("CWE-250", "CWE-489", "CWE-1104", "CWE-16")
CRA_EXPLOITED = "Article 14 (reporting of actively exploited vulnerabilities)"


def asvs_rows() -> list[tuple[str, str, str]]:
    return [(f"CWE-{n}", c, ASVS_CHAPTERS[c]) for c, ns in ASVS_WEAKNESSES.items() for n in ns]


def pci_rows() -> list[tuple[str, str]]:
    return [(f"CWE-{n}", r) for r, ns in PCI_WEAKNESSES.items() for n in ns]


def cra_clauses(cwe: Column, is_dependency: Column, exploited: Column) -> Column:
    some = [*map(F.lit, CRA_ALWAYS), F.when(is_dependency, CRA_DEPENDENCY), F.when(cwe.isin(*CRA_DEFAULTS_CWES), CRA_DEFAULTS), F.when(exploited, CRA_EXPLOITED)]
    return F.array_compact(F.array(*some))


def register(findings: DataFrame) -> DataFrame:
    """Adds asvs, asvs_title, pci (null where none is asserted), pci_refused and cra (clauses joined by '; ').

    The two dimensions have some fifty rows each, fixed in this module, and are broadcast."""
    spark = findings.sparkSession
    asvs = spark.createDataFrame(asvs_rows(), "cwe string, asvs string, asvs_title string")
    pci = spark.createDataFrame(pci_rows(), "cwe string, pci string")
    dependency = (F.col("package") != "") if "package" in findings.columns else F.lit(False)
    exploited = (F.col("exploitation") == "exploited") if "exploitation" in findings.columns else F.lit(False)
    rows = findings.join(F.broadcast(asvs), "cwe", "left").join(F.broadcast(pci), "cwe", "left")
    return rows.withColumn("pci_refused", F.col("cwe").isin(*PCI_REFUSED)).withColumn("cra", F.array_join(cra_clauses(F.col("cwe"), dependency, exploited), "; "))
