"""Request values that reach a sink in PHP files: relational, line by line, one hop of propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditweave.functions.text import evidence

#: Request superglobals, sanitisers, and the six sinks in order of precedence.
SUPERGLOBAL = r"\$_(?:GET|POST|REQUEST|COOKIE|FILES)"
SANITISED = (
    r"(?i)\b(?:intval|floatval|boolval|abs|count|htmlspecialchars|htmlentities|strip_tags|mysqli_real_escape_string|pg_escape_string|pg_escape_literal|preg_quote|filter_var|"
    r"is_numeric|is_int|urlencode|rawurlencode|basename|md5|sha1|hash|password_hash)\s*\("
)
SINKS = (
    ("TAINT-PHP-SQLI", "CWE-89", "Critical", r"(?i)SELECT\b[^;\n]{0,200}\bFROM\b|INSERT\s+INTO\b|UPDATE\b[^;\n]{0,200}\bSET\b|DELETE\s+FROM\b"),
    ("TAINT-PHP-LFI", "CWE-98", "Critical", r"\b(?:include|include_once|require|require_once)\b"),
    ("TAINT-PHP-CMDI", "CWE-78", "Critical", r"(?<![\w>:$])(?<!function )(?:system|exec|shell_exec|passthru|popen|proc_open)\s*\("),
    ("TAINT-PHP-PATH", "CWE-22", "High", r"\b(?:file_get_contents|file_put_contents|fopen|readfile|unlink|copy|rename|move_uploaded_file|scandir|opendir)\s*\("),
    ("TAINT-PHP-HEADER", "CWE-601", "Medium", r"\bheader\s*\("),
    ("TAINT-PHP-XSS", "CWE-79", "High", r"(?:\becho\b|\bprint\b|<\?=)"),
)
ASSIGN = rf"\$([A-Za-z_]\w*)\s*=\s*[^;\n]*{SUPERGLOBAL}\s*\["
HOP = r"^\s*\$([A-Za-z_]\w*)\s*=\s*([^;\n]*)"
NAME = r"\$([A-Za-z_]\w*)"
LONGEST = 2000


def php_paths(files: DataFrame, longest: int | None = LONGEST) -> DataFrame:
    """files: file, text. Rows: sink_id, cwe, severity, confidence, file, line, source, source_line, evidence, source_evidence.

    One hop: a name that a line assigns from a request value, and a name that a line assigns from such a name. Lines of more
    than ``longest`` characters are left out (generated code; None: none is), ``long_lines`` counts them."""
    php = files.filter(F.lower("file").rlike(r"\.(?:php|phtml)$") & F.regexp_like("text", F.lit(SUPERGLOBAL)))
    lines = php.select("file", F.posexplode(F.split("text", "\n", -1)).alias("at", "text")).withColumn("line", F.col("at") + 1)
    lines = lines if longest is None else lines.filter(F.length("text") <= longest)
    first = Window.partitionBy("file", "name").orderBy("line", "ord")
    direct = lines.filter(~F.regexp_like("text", F.lit(SANITISED))).select("file", "line", "text", F.posexplode(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(1))).alias("ord", "name"))
    direct = direct.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("file", "name", F.col("line").alias("source_line"), F.col("text").alias("source_text"))
    hops = lines.withColumn("name", F.regexp_extract("text", HOP, 1)).withColumn("right", F.regexp_extract("text", HOP, 2)).filter((F.col("name") != "") & ~F.regexp_like("right", F.lit(SANITISED)))
    used = hops.select("file", "line", "name", F.explode(F.array_distinct(F.regexp_extract_all("right", F.lit(NAME), F.lit(1)))).alias("from"))
    hop = used.join(direct.withColumnRenamed("name", "from"), ["file", "from"]).withColumn("_n", F.row_number().over(Window.partitionBy("file", "name").orderBy("line", "source_line", "from"))).filter("_n = 1")
    hop = hop.join(direct.select("file", "name"), ["file", "name"], "left_anti").select("file", "name", "source_line", "source_text")
    origin = direct.unionByName(hop)
    sink = F.coalesce(*(F.when(F.regexp_like("text", F.lit(p)), F.struct(F.lit(i).alias("sink_id"), F.lit(c).alias("cwe"), F.lit(s).alias("severity"))) for i, c, s, p in SINKS))
    reached = lines.filter(~F.regexp_like("text", F.lit(ASSIGN))).withColumn("sink", sink).filter("sink is not null")
    reached = reached.select("file", "line", "text", "sink", F.posexplode(F.regexp_extract_all("text", F.lit(NAME), F.lit(1))).alias("ord", "name")).join(origin, ["file", "name"])
    reached = reached.withColumn("_n", F.row_number().over(Window.partitionBy("file", "line").orderBy("ord"))).filter("_n = 1")
    return reached.select("sink.*", F.lit("medium").alias("confidence"), "file", "line", F.concat(F.lit("$"), "name", F.lit(" (from a superglobal)")).alias("source"), "source_line", evidence(F.col("text")).alias("evidence"), evidence(F.col("source_text")).alias("source_evidence"))


def long_lines(files: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(file, n): lines that ``php_paths`` leaves out for their length."""
    php = files.filter(F.lower("file").rlike(r"\.(?:php|phtml)$")).select("file", F.explode(F.split("text", "\n", -1)).alias("text"))
    return php.filter(F.length("text") > longest).groupBy("file").agg(F.count("*").alias("n"))
