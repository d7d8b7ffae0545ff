"""Rule sets as data: ordered categories, each with literal keywords or patterns.

`Category.keywords` are literal substrings of the lower-cased text; `Category.patterns` are regular
expressions. Order is precedence. `needs_context` names keywords that only count when one of the words
in `context` is present too; with `veto` such a lone keyword rules out the whole category.
"""

from __future__ import annotations

from dataclasses import dataclass

OTHER = "Other Error"
UNCLEAR = "Empty or Unclear Error"


@dataclass(frozen=True)
class Category:
    name: str
    keywords: tuple[str, ...]
    patterns: tuple[str, ...] = ()
    all_of: tuple[tuple[str, ...], ...] = ()
    needs_context: tuple[str, ...] = ()
    context: tuple[str, ...] = ("import", "module")
    veto: bool = False


# ---- fixed values: category names, keywords and patterns must equal the analysed tool's lists ----

REDECLARATION = "Redeclaration/Duplicate Definition"
IMPORT = "Import/Module Resolution Error"
SYNTAX = "Syntax Error"
RESOLUTION = "Resolution Error (Type/Variable/Function Not Found)"
MEMBER = "Member Access/Usage Error (Field/Method/Visibility)"
TYPE = "Type Mismatch/Compatibility Error"
CONSTRUCTOR = "Constructor Call Error"
STRUCTURE = "File/Structural Error (e.g., Java package)"
UNHANDLED = "Unhandled Exception"

UNRESOLVED = ("could not be resolved",)

# fixed values: how syntax errors are worded; both lists of categories have them
SYNTAX_WORDS = (
    "syntax error", "misplaced construct", "expected", "unexpected token", "was not closed", 'insert "',
    "delete this token", "invalid compilationunit", "unexpected indentation", "unindent not expected",
    "invalid character constant", "statements must be separated", "no new variables on left side of :=",
    "positional argument cannot appear after keyword arguments", "unterminated", "illegal character",
    "await allowed only within async function", 'expecting "}"', "invalid escape sequence",
    "not properly closed by a double-quote", "missing ',' in composite literal",
    "enum classes must not be local",
)

# Intended reading of the seven-category list: separators restored, case folded, patterns as patterns.
SEVEN = (
    Category(
        REDECLARATION,
        (
            "redeclared in this block", "other declaration of", "already declared", "is already defined",
            "field and method with the same name", "duplicate field name",
        ),
    ),
    Category(
        IMPORT,
        (
            "import", "could not be resolved", "no required module provides package", "expected module name",
            "does not match the expected package", "module", "cannot be resolved to a type", "is not defined",
            "undefined:", "cannot be resolved", "cannot find symbol", "missing type",
            "lambda expression refers to the missing type", "is not a type", "must be defined in its own file",
            "should be declared in a file named", "implicitly declared class must have",
        ),
        patterns=(
            r"use of package .* not in selector", r"from \.\./.*_test\.go", r"declared package .* does not match",
        ),
        needs_context=UNRESOLVED,
    ),
    Category(
        SYNTAX,
        (
            *SYNTAX_WORDS,
            "missing ',' before newline in composite literal", "must implement the inherited abstract method", "must override or implement a supertype method",
            "name clash", "does not override", "cannot override final method",
            "cannot reduce the visibility of the inherited method",
        ),
    ),
    Category(
        MEMBER,
        (
            "unknown field", "has no field or method", "is undefined for the type", "is not visible", "not a field",
            "no field or method", "undefined (type", "private access in", "cannot refer to unexported field",
            "cannot override the final method", "illegal enclosing instance specification",
            "cannot subclass the final class",
        ),
        patterns=(r"cannot invoke .* on the array type", r"error\(\) string"),
    ),
    Category(
        TYPE,
        (
            "cannot use", "is not applicable for the arguments", "type mismatch", "incompatible with",
            "cannot convert", "cannot assign", "bound mismatch", "invalid operation:", "incompatible types",
            "must be a functional interface", "invalid composite literal type", "cannot cast from",
            "assignment mismatch", "too many arguments in call", "not enough arguments in call",
            "non-boolean condition in if statement", "no value) used as value", "(type) is not an expression",
            "anonymous class cannot subclass", "first argument to append must be a slice",
            "cannot inherit from final", "is an invalid type for the variable", "no suitable method found",
            "argument mismatch", "cannot be parameterized with arguments", "cannot be converted to",
            "invalid argument", "cannot infer type arguments", "is not compatible with throws clause",
            "return type for the method is missing", "an exception type must be a subclass of",
            "(no value) used as value", "missing ',' before newline in composite literal",
        ),
        patterns=(
            r"cannot invoke .* on the array type", r"return type .* is not compatible with",
            r"cannot invoke .* on the primitive type", r"does not define .* that is applicable here",
            r"multiple-value .* in single-value context", r"\(value of type .* in single-value context",
            r"\(value of type .* for built-in",
        ),
    ),
    Category(CONSTRUCTOR, ("constructor", "cannot instantiate the type")),
    Category(
        UNHANDLED,
        (
            "unhandled exception type", "unreachable code", "unreachable catch block", "unreported exception",
            "must be caught or declared to be thrown",
        ),
    ),
)

# Literal reading of the same list: neighbours fused where a separator is missing, capitals and
# pattern-looking keywords kept as literals that lower-cased text can hardly contain.
SEVEN_COMPAT = (
    SEVEN[0],
    Category(
        IMPORT,
        (
            "import", "could not be resolved", "no required module provides package", "expected module name",
            "does not match the expected package", "use of package .* not in selector", "module",
            "use of package .* not in selector", r"from \.\./.*_test\.gocannot be resolved to a type",
            "is not defined", "undefined:", "cannot be resolved", "cannot find symbol", "missing type",
            "lambda expression refers to the missing type", "is not a typemust be defined in its own file",
            "declared package .* does not match", "should be declared in a file named",
            "implicitly declared class must have",
        ),
        needs_context=UNRESOLVED,
    ),
    Category(
        SYNTAX,
        (
            "syntax error", "misplaced construct", "expected", "unexpected token", "was not closed", 'insert "',
            "delete this token", "invalid compilationunit", "unexpected indentation", "unindent not expected",
            "invalid character constant", "statements must be separated", "no new variables on left side of :=",
            "positional argument cannot appear after keyword arguments", "unterminated", "illegal character",
            "await allowed only within async function", 'expecting "}"', "invalid escape sequence",
            "not properly closed by a double-quote", "missing ',' in composite literal",
            "enum classes must not be localmissing ',' before newline in composite literal", "import",
            "could not be resolved", "no required module provides package", "expected module name",
            "does not match the expected package", "use of package .* not in selector", "module",
            "use of package .* not in selector",
            r"from \.\./.*_test\.gomust implement the inherited abstract method",
            "must override or implement a supertype method", "name clash", "does not override",
            "cannot override final method", "cannot reduce the visibility of the inherited method",
        ),
        needs_context=UNRESOLVED,
    ),
    Category(
        MEMBER,
        (
            "unknown field", "has no field or method", "is undefined for the type", "is not visible", "not a field",
            "no field or method", "undefined (type", "private access in", "cannot refer to unexported field",
            "Cannot override the final method", "Illegal enclosing instance specification",
            "cannot subclass the final classCannot invoke .* on the array type", r"Error\(\) string",
        ),
    ),
    Category(
        TYPE,
        (
            "cannot use", "is not applicable for the arguments", "type mismatch", "incompatible with",
            "cannot convert", "cannot assign", "bound mismatch", "invalid operation:", "incompatible types",
            "must be a functional interface", "invalid composite literal type", "cannot cast from",
            "assignment mismatch", "too many arguments in call", "not enough arguments in call",
            "non-boolean condition in if statement", r"no value\) used as value", r"\(type\) is not an expression",
            "anonymous class cannot subclass", "first argument to append must be a slice",
            "cannot inherit from final", "is an invalid type for the variable", "no suitable method found",
            "argument mismatch", "cannot invoke .* on the array type", "cannot be parameterized with arguments",
            "return type .* is not compatible with", "cannot be converted to",
            "invalid argumentCannot infer type arguments", "Cannot invoke .* on the primitive type",
            "Cannot invoke .* on the array type", "is not compatible with throws clause",
            "Return type for the method is missing", "does not define .* that is applicable here",
            r"an exception type must be a subclass of\(no value\) used as value",
            "multiple-value .* in single-value context", r"\(value of type .* in single-value context",
            r"\(value of type .* for built-in", "missing ',' before newline in composite literal",
        ),
    ),
    SEVEN[5],
    SEVEN[6],
)

TEN = (
    Category(REDECLARATION, ("redeclared in this block", "other declaration of", "already declared")),
    Category(
        IMPORT,
        (
            "import", "could not be resolved", "no required module provides package", "imported and not used",
            "expected module name", "does not match the expected package",
        ),
        needs_context=UNRESOLVED,
    ),
    Category(
        SYNTAX,
        (
            "syntax error", "misplaced construct", "expected", "unexpected token", "was not closed", 'insert "',
            "delete this token", "invalid compilationunit", "unexpected indentation", "unindent not expected",
            "invalid character constant",
        ),
    ),
    Category(
        RESOLUTION,
        ("cannot be resolved to a type", "is not defined", "undefined:", "cannot be resolved", "cannot find symbol"),
    ),
    Category(
        MEMBER,
        (
            "unknown field", "has no field or method", "is undefined for the type", "is not visible", "not a field",
            "no field or method", "undefined (type", "cannot assign to",
        ),
    ),
    Category(
        TYPE,
        (
            "cannot use", "is not applicable for the arguments", "type mismatch", "incompatible with",
            "cannot convert", "cannot assign", "bound mismatch", "invalid operation:", "incompatible types",
        ),
    ),
    Category(CONSTRUCTOR, ("constructor", "cannot instantiate the type")),
    Category(STRUCTURE, ("must be defined in its own file", "declared package .* does not match")),
    Category(UNHANDLED, ("unhandled exception type",)),
)

CONSTRUCTOR_FIRST = (
    Category(CONSTRUCTOR, ("cannot instantiate the type",), all_of=(("constructor", "is undefined"),)),
    SEVEN[0],
    Category(
        IMPORT,
        (
            "import", "could not be resolved", "no required module provides package", "expected module name",
            "does not match the expected package", "use of package", "module", "cannot be resolved to a type",
            "is not defined", "undefined:", "cannot be resolved", "cannot find symbol", "missing type",
            "lambda expression refers to the missing type", "is not a type", "must be defined in its own file",
            "declared package", "should be declared in a file named",
        ),
        needs_context=UNRESOLVED,
        veto=True,
    ),
    Category(SYNTAX, SYNTAX_WORDS),
    Category(MEMBER, SEVEN[3].keywords + ("cannot invoke .* on the array type", "error() string")),
    Category(
        TYPE,
        (
            "cannot use", "is not applicable for the arguments", "type mismatch", "incompatible with",
            "cannot convert", "cannot assign", "bound mismatch", "invalid operation:", "incompatible types",
            "must be a functional interface", "invalid composite literal type", "cannot cast from",
            "assignment mismatch", "too many arguments in call", "not enough arguments in call",
            "no value) used as value", "(type) is not an expression",
            "first argument to append must be a slice", "no suitable method found", "argument mismatch",
            "cannot be parameterized with arguments", "return type .* is not compatible with",
            "cannot be converted to", "invalid argument", "cannot infer type arguments",
        ),
    ),
    SEVEN[6],
)

PRESETS = {"seven": SEVEN, "seven_compat": SEVEN_COMPAT, "ten": TEN, "constructor_first": CONSTRUCTOR_FIRST}

IGNORED_PREFIXES = ("The error messages are:", "```")

UNCLEAR_SHORT = r"^[a-zA-Z0-9_.,;:(){}\[\]<>\"'*/&|\s-]{1,20}$"
ERROR_WORDS = ("error", "failed", "unable", "warning", "exception")

ERROR_STATUS = {
    "ImportError": "Import Errors",
    "ModuleNotFoundError": "Import Errors",
    "TypeError": "Type Errors",
    "AttributeError": "Attribute Errors",
    "ValueError": "Value Errors",
    "NameError": "Name Errors",
    "SyntaxError": "Syntax Errors",
    "IndentationError": "Syntax Errors",
}

STAGES = {
    "gatherContext-1": "def",
    "gatherContext-2": "ref",
    "getDiagnosticsForFilePath": "diag",
    "generateTest": "gen",
    "buildCFG": "cfg",
    "collectCFGPaths": "cfg",
    "getContextTermsFromTokens": "filter",
    "saveGeneratedCodeToFolder": "save",
}
NOT_COUNTED = ("fixDiagnostics", "gatherContext")

SKIP_TOKEN_TYPES = (
    "builtinConstant", "comment", "string", "number", "boolean", "null", "undefined", "object", "array",
)
DEFINITION_TYPES = ("function", "class", "method", "global", "member")

CODE_EXTENSIONS = {
    "java": "Java", "py": "Python", "js": "JavaScript", "ts": "TypeScript", "cpp": "C++", "c": "C",
    "h": "C/C++ Header", "cs": "C#", "go": "Go", "rb": "Ruby", "php": "PHP", "swift": "Swift", "kt": "Kotlin",
    "rs": "Rust",
}
IGNORED_DIRS = (
    "node_modules", ".git", "__pycache__", "target", "build", "dist", ".idea", ".vscode", "venv", "env", ".gradle",
)

MODELS = ("gpt-4o", "gpt-4o-mini", "deepseek-chat")
MODEL_ORDER = ("gpt-4o-mini", "gpt-4o", "deepseek-chat")
MODEL_SHORT = {"gpt-4o-mini": "4o-mini", "gpt-4o": "4o", "deepseek-chat": "deepseek"}
PYTHON_PROJECT_LINES = {"black": 7523, "tornado": 8955}
PYTHON_DEFAULT_LINES = 7555

DECISIONS = {"1": "added_to_existing", "2": "created_small_category", "3": "created_big_category"}
DEFAULT_CATEGORIES = {
    "Wrong Environment": ("workspace error", "platform/file generation error"),
    "Mock error": (),
    "Symbol Misusing": ("re-declare already declared symbol",),
    "Object Property Error": (),
    "Logic Error": (),
}

CODE_CHECKS = {
    "python": (
        (("import unittest",), "Python test should import unittest"),
        (("class Test",), "Python test should define a TestCase class"),
        (("def test_",), "Python test should define test methods (def test_*)"),
    ),
    "java": (
        (("@Test",), "Java test should include @Test annotations"),
        (("import org.junit",), "Java test should import JUnit"),
    ),
    "go": (
        (("func Test",), "Go test should define Test functions"),
        (("import", '"testing"'), "Go test should import testing package"),
    ),
    "cpp": ((("TEST(",), "C++ test should include TEST() macros"),),
    "c++": ((("TEST(",), "C++ test should include TEST() macros"),),
}
SHORT_CODE = "Generated code is very short, may be incomplete"
# ---- end of fixed values ----
