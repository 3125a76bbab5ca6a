"""Candidates from code: one grammar with a table of rules per language, read by a bracket tree (``brackets``).

A literal is judged by where it stands: in which call, behind which label or target, in which statement. No syntax tree is
built: where the position is not one of the listed ones the literal is left alone (or, for C#, reported as a plain code literal).
Files are read one by one in Arrow batches, without a shuffle; what follows (unescaping, format strings, noise) is built-in.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.escapes import unescape_code
from ..functions.noise import drop_noise
from ..functions.text import extract_all, one_line, preview, re2  # noqa: F401
from ..session import evaluate_once
from .brackets import Grammar, Rule, call

# --- fixed values: literal shapes -----------------------------------------------------------
# possessive repetition keeps the JVM matcher iterative on long literals; dropping the extra '+' gives RE2
DOUBLE = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"'
SINGLE = r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
BACKTICK = r"`[^`\\]*+(?:\\.[^`\\]*+)*+`"
TRIPLE_DOUBLE = r'""".*?"""'
TRIPLE_SINGLE = r"'''.*?'''"
VERBATIM = r'\$?@\$?"[^"]*+(?:""[^"]*+)*+"'
INTERPOLATED = r'\$"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"'
RAW_HASH = r'#+".*?"#+'
#: A Dart literal is raw behind an r that ends no word; the r stays in the gap before it.
RAW_BEFORE = r"(?<=r)(?<![A-Za-z0-9_$]r)"


def _calls(*names: str) -> str:
    return call(*names)


def _labels(*names: str) -> str:
    return r"(?:^|[^A-Za-z0-9_])(?:" + "|".join(names) + r")[ \t]*:[ \t\r\n]*$"


def _named(*names: str) -> str:
    return r"(?:^|[^A-Za-z0-9_])(?:" + "|".join(names) + r")[ \t]*=[ \t\r\n]*$"


def _members(*names: str) -> str:
    return r"\.(?:" + "|".join(names) + r")[ \t]*=[ \t\r\n]*$"


def _words(text: str) -> list[str]:
    return text.split()


DIALECTS = {
    "swift": Grammar(
        strings=(RAW_HASH, TRIPLE_DOUBLE, DOUBLE), starts="\"/#", nested_comments=True, skip=r"\\\(",
        rules=(
            Rule("call", _calls("NSLocalizedString", "LocalizedStringKey", "LocalizedStringResource")),
            Rule("gap", _labels(*_words("localized verbatim systemName systemImage named identifier withIdentifier forKey key tableName comment ofType withExtension"))),
            Rule("inside", _calls("print", "debugPrint", "NSLog", "os_log", "fatalError", "assertionFailure", "preconditionFailure", r"[Ll]ogger\.[a-z]+"), "Diagnostic"),
            Rule("call", _calls(*_words(
                r"Text Label Button TextField SecureField Toggle Picker Section Menu Link NavigationLink DisclosureGroup GroupBox Stepper ProgressView"
                r" \.?navigationTitle \.?navigationBarTitle \.?alert \.?confirmationDialog \.?help \.?accessibilityLabel \.?accessibilityHint"
                r" \.?accessibilityValue setTitle setText")), "UiCall"),
            Rule("gap", _labels(*_words("title message placeholder prompt label subtitle actionTitle buttonTitle")), "NamedArgument"),
            Rule("gap", _members(*_words("text title placeholder prompt subtitle message accessibilityLabel accessibilityHint")), "Assignment"),
        )),
    "objc": Grammar(
        strings=("@" + DOUBLE, DOUBLE, SINGLE), starts="\"'/@", candidate=r'(?s)^@".+"$', skip=r"%@",
        rules=(
            Rule("call", _calls("NSLocalizedString[A-Za-z]*")),
            Rule("gap", _labels(*_words("imageNamed forKey objectForKey stringForKey withIdentifier isEqualToString initWithFormat hasPrefix hasSuffix"))),
            Rule("inside", _calls("NSLog", "os_log", "NSAssert", "DDLog[A-Z][a-z]+"), "Diagnostic"),
            Rule("gap", _labels(*_words(
                "setTitle setText setPlaceholder setMessage setPrompt initWithTitle alertControllerWithTitle actionWithTitle alertWithTitle"
                " setAccessibilityLabel setAccessibilityHint setToolTip")), "UiCall"),
            Rule("gap", _labels(*_words("title message placeholder prompt subtitle informativeText messageText label")), "NamedArgument"),
            Rule("gap", _members(*_words("text title placeholder prompt message accessibilityLabel accessibilityHint toolTip")), "Assignment"),
        )),
    "dart": Grammar(
        strings=tuple(RAW_BEFORE + q for q in (TRIPLE_DOUBLE, TRIPLE_SINGLE, r'"[^"\n]*+"', r"'[^'\n]*+'")) + (TRIPLE_DOUBLE, TRIPLE_SINGLE, DOUBLE, SINGLE),
        nested_comments=True, adjacent=True,
        candidate=r"""(?s)^(?:"[^"].*"|'[^'].*'|"[^"]"|'[^']')$""", skip=r"(?:^|[^\\])\$[A-Za-z_{]",
        blocked=(("const scope", r"(?:^|[^A-Za-z0-9_])const[ \t\r\n]"),),
        scope=r"(?<![A-Za-z0-9_])BuildContext[ \t]+context(?![A-Za-z0-9_])", out_of_scope="no build context in scope",
        rules=(
            Rule("gap", r"(?:^|[^A-Za-z0-9_])r$"),
            Rule("call", _calls("Key", "ValueKey", "RegExp", r"Uri\.parse", "AssetImage", r"Image\.asset", "MethodChannel")),
            Rule("gap", _labels(*_words("restorationId fontFamily package name heroTag"))),
            Rule("inside", _calls("print", "debugPrint", "log", r"developer\.log", "[A-Za-z]*Exception", "[A-Za-z]*Error", r"[Ll]ogger\.[a-z]+"), "Diagnostic"),
            Rule("call", _calls("Text", "SelectableText", "TextSpan", "Tooltip"), "UiCall"),
            Rule("gap", _labels(*_words(
                "title label labelText hintText helperText errorText tooltip message semanticLabel semanticsLabel subtitle text counterText"
                " prefixText suffixText barrierLabel applicationName placeholder")), "NamedArgument"),
        )),
    "android": Grammar(
        strings=(TRIPLE_DOUBLE, DOUBLE, SINGLE), nested_comments=True, skip=r"(?:^|[^\\])\$[A-Za-z_{]", window=(40, 60),
        rules=(
            Rule("within", r"@[A-Za-z.]+$"),
            Rule("call", _calls("getString", "stringResource", "getText", "findPreference")),
            Rule("within", _calls(r"Log\.[vdiwe]", r"Timber\.[a-z]+", "println", "[A-Za-z]+Exception", "error", "require", "check"), "Diagnostic"),
            Rule("call", _calls(*_words(
                "setText setTitle setSubtitle setMessage setHint setContentDescription setPositiveButton setNegativeButton setNeutralButton"
                " setError setSummary setContentTitle setContentText setSubText setTicker setTooltipText setQueryHint setLabel"
                " announceForAccessibility Text")), "UiCall"),
            Rule("later", _calls(r"Toast\.makeText", r"Snackbar\.make"), "UiSecondArgument"),
            Rule("gap", _named(*_words("text label contentDescription title message hint placeholder subtitle summary error")), "NamedArgument"),
        )),
    "script": Grammar(
        strings=(BACKTICK, DOUBLE, SINGLE), starts="\"'`/", candidate=r"""(?s)^(?:"[^"].*"|'[^'].*'|`[^`].*`)$""", skip=r"\$\{|\\",
        rules=(
            Rule("call", _calls("t", r"\$t", r"i18n\.t", r"i18next\.t", "require", "import", "formatMessage")),
            Rule("call", _calls(*_words(
                r"alert confirm prompt toast toast\.[a-z]+ notify showToast showNotification showMessage enqueueSnackbar"
                r" message\.(?:success|error|info|warning) notification\.[a-z]+ setErrorMessage")), "UiCall"),
        )),
    "csharp": Grammar(
        strings=(TRIPLE_DOUBLE, VERBATIM, INTERPOLATED, DOUBLE, SINGLE), starts="\"'/@$", candidate=r'(?s)^[$@]{0,2}"(?:[^"]|[^"].*)"$',
        default="CodeLiteral", whole_statement=240,
        rules=(
            Rule("gap", r"(?:==|!=)[ \t\r\n]*$"),
            Rule("within", r"(?:==|!=)[ \t\r\n]*$"),
            Rule("within", _calls(r"Assert\.[A-Z][A-Za-z]*")),
            Rule("gap", r"(?:^|[^A-Za-z0-9_])(?:case|is|is not|or|using)[ \t\r\n]+$"),
            Rule("gap", r"(?:^|[^A-Za-z0-9_])const[ \t]+string[ \t]+[A-Za-z0-9_]+[ \t]*=[ \t\r\n]*$"),
            Rule("call", _calls("nameof", r"[A-Za-z0-9_.]*\.(?:" + "|".join(_words(
                "Equals Contains StartsWith EndsWith IndexOf LastIndexOf Compare CompareTo Replace Split Trim ContainsKey TryGetValue TryAdd"
                " GetValue GetSection GetConnectionString GetString GetEnvironmentVariable GetProperty")) + ")")),
            Rule("index", _calls("L", "T", "[A-Za-z_]*[Ll]ocalizer", "Strings")),
            Rule("within", r"^\[(?:" + "|".join(_words(
                "Route Http(?:Get|Post|Put|Delete|Patch) JsonPropertyName JsonProperty Column Table DllImport Fact Trait InlineData Authorize FromQuery"
                " FromRoute FromHeader ActionName Area XmlElement XmlAttribute DataMember EnumMember ConfigurationKeyName")) + ")$"),
            Rule("after", r"[ \t\r\n]*(?:==|!=|=>|or[ \t\r\n])"),
            Rule("within", _calls(
                r"[A-Za-z0-9_.]*[Ll]og[A-Za-z]*(?:\.[A-Z][A-Za-z]+)?", r"Debug\.[A-Z][A-Za-z]+", r"Trace\.[A-Z][A-Za-z]+", r"Console\.(?:Error\.)?Write(?:Line)?",
                r"new[ \t]+[A-Za-z]*Exception"), "Diagnostic"),
            Rule("statement", r"(?:^|[^A-Za-z0-9_])throw[ \t\r\n]", "Diagnostic"),
            Rule("within", r"^\[[A-Za-z.]+$", "Attribute"),
        )),
}


def literal_body(raw: Column, inner: Column, dialect: str) -> Column:
    """Text of a literal: a C# ``@`` literal has no escapes but doubled quotes, elsewhere ``@`` is an ordinary prefix."""
    if dialect == "csharp":
        return F.when(raw.rlike(r"^(\$@|@)"), F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(unescape_code(inner))
    return unescape_code(inner)


# --- interpolation to a format string ---------------------------------------------------------

PIECE = r"\{\{|\}\}|\{[^{}]*\}|[^{}]+|[{}]"


def _is_hole(p: Column) -> Column:
    return p.rlike(r"^\{[^{}]+\}$")


def join_numbered(pieces: Column) -> Column:
    def numbered(p: Column, i: Column) -> Column:
        before = F.size(F.filter(F.slice(pieces, F.lit(1), i), _is_hole))
        return F.when(_is_hole(p), F.concat(F.lit("{"), before.cast("string"), F.lit("}"))).otherwise(p)

    return F.array_join(F.transform(pieces, numbered), "")


def hole_expressions(pieces: Column) -> Column:
    holes = F.transform(F.filter(pieces, _is_hole), lambda h: F.substring(h, F.lit(2), F.length(h) - 2))
    return F.when(~F.exists(holes, lambda h: h.rlike(r"[,:]")), holes)


def format_string(body: Column) -> Column:
    """``Hi {name}, {n} left`` -> ``Hi {0}, {1} left``; doubled braces stay doubled."""
    return join_numbered(extract_all(body, PIECE))


def format_arguments(body: Column) -> Column:
    """Hole expressions, or null when one carries an alignment or format clause (not rewritable)."""
    return hole_expressions(extract_all(body, PIECE))


FOUND = T.StructType([
    T.StructField("span_start", T.IntegerType()), T.StructField("span_length", T.IntegerType()), T.StructField("line", T.IntegerType()),
    T.StructField("raw", T.StringType()), T.StructField("inner", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("member", T.StringType()), T.StructField("reason", T.StringType()), T.StructField("around", T.StringType()),
])
_ORDER = itemgetter("start", "length", "line", "raw", "inner", "kind", "member", "reason", "context")
#: Rows of a batch that leaves the reader; a file's literals may fill many.
ROWS = 4096


def literals(df: DataFrame, keep: list[str], content: str, dialect: str) -> DataFrame:
    """(keep…, span_start, span_length, line, raw, inner, kind, member, reason, around) of every literal in a listed position."""
    source = df.select(*keep, F.col(content).alias("_content"))
    schema = T.StructType(source.schema.fields[:-1] + FOUND.fields)
    grammar, at = DIALECTS[dialect], len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        reader, types = grammar.compiled(), to_arrow_schema(schema)
        rows: list[int] = []
        cells: list[tuple] = []

        def full(batch: pa.RecordBatch) -> pa.RecordBatch:
            place = pa.array(rows, pa.int32())
            kept = [batch.column(i).take(place) for i in range(at)]
            found = [pa.array(c, types.field(at + i).type) for i, c in enumerate(zip(*cells))]
            rows.clear()
            cells.clear()
            return pa.RecordBatch.from_arrays(kept + found, schema=types)

        for batch in batches:
            contents = batch.column(at)
            for i in range(batch.num_rows):
                text = contents[i].as_py()
                for hit in reader.read(text) if text else ():
                    rows.append(i)
                    cells.append(_ORDER(hit))
                    if len(rows) >= ROWS:
                        yield full(batch)
            if rows:
                yield full(batch)

    return source.mapInArrow(run, schema)


def candidates(df: DataFrame, keep: list[str], content: str, dialect: str, include_diagnostics: bool = False) -> DataFrame:
    """One row per accepted literal with its exact span in the original text."""
    g = DIALECTS[dialect]
    found = literals(df, keep, content, dialect)
    if not include_diagnostics:
        found = found.filter(F.col("kind") != "Diagnostic")
    cols = [*found.columns]
    t = F.col("raw")
    found = evaluate_once(found, cols, body=literal_body(t, F.col("inner"), dialect))
    if dialect == "csharp":
        found = evaluate_once(found, [*cols, "body"], pieces=F.when(t.rlike(r"^\$@?\"|^@\$\""), extract_all(F.col("body"), PIECE)))
        is_format = F.coalesce(F.exists("pieces", _is_hole), F.lit(False))
        text = F.when(is_format, join_numbered(F.col("pieces"))).otherwise(F.col("body"))
        args = F.when(is_format, hole_expressions(F.col("pieces")))
    else:
        is_format, text, args = F.lit(False), F.col("body"), F.lit(None).cast("array<string>")
    reason = F.when(is_format & args.isNull(), F.lit("format clause in interpolation")).otherwise(F.col("reason"))
    found = evaluate_once(found, found.columns, text=text)
    context = one_line(F.col("around"))
    # columns that no filter reads stay plain: a query that drops them never computes them
    out = found.select(
        *keep,
        F.lit(2).alias("phase"),
        "span_start",
        "span_length",
        "line",
        "text",
        t.alias("raw"),
        "kind",
        (preview(context, g.whole_statement) if g.whole_statement else context).alias("context"),
        "member",
        reason.cast("string").alias("blocked_reason"),
        is_format.alias("is_interpolated"),
        args.alias("interpolation_args"),
    )
    return drop_noise(out)


def file_traits(content: Column) -> Column:
    """What a Kotlin/Java file can resolve, computed once per file."""
    return F.struct(
        F.contains(content, F.lit("androidx.compose")).alias("uses_compose"),
        content.rlike(r"@Composable[ \t\r\n]").alias("has_composable"),
        content.rlike(r"(?:class|object)[ \t]+[A-Za-z0-9_]+[^{\n]*(?:Activity|Fragment|Service|Context|View)\b").alias("has_context"),
        content.rlike(r"(?m)^import[ \t]+[a-z][A-Za-z0-9_.]*\.R;?[ \t]*$").alias("imports_r"),
    )
