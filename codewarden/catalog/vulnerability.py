"""Vulnerability rules.

Fixed values: rule ids, titles, patterns, flags, severities, CWE codes and file
types decide which findings are reported and how they rank, so they are stated
as they are.  Descriptions, recommendations and ``needs`` literals are ours.
"""

from __future__ import annotations

from codewarden.catalog.model import Rule

JS = (".js", ".ts", ".jsx", ".tsx", ".mjs", ".cjs")
PY = (".py",)
JAVA = (".java",)
CS = (".cs",)
C = (".c", ".cpp", ".cc", ".cxx", ".h", ".hpp")
PHP = (".php", ".phtml")
GO = (".go",)
RB = (".rb", ".rake")
RS = (".rs",)
KT = (".kt", ".kts")
SWIFT = (".swift",)
SH = (".sh", ".bash")
DART = (".dart",)
SCALA = (".scala",)
TF = (".tf", ".hcl")
DOCKER = (".dockerfile", "dockerfile")
YAML = (".yaml", ".yml")

CONFIDENCE = 0.85


def _v(rule_id, title, severity, cwe, types, flags, needs, pattern, description, advice, **kw):
    return Rule(
        rule_id=rule_id, title=title, severity=severity, pattern=pattern, flags=flags, cwe=cwe,
        file_types=types, needs=needs, description=description, recommendation=advice,
        category="vulnerability", confidence=CONFIDENCE, **kw,
    )


# ``\s`` is part of the run's class, so the run never has to give a character
# back, and a match can only begin where a run begins or where the previous
# match stopped.  Saying so keeps the search linear in the text.
_SCALA_PROCESS_LINEAR = (
    r"""(?:s['"`][^'"`\n]*['"`]|(?:(?<![\w\s+])|\G)[\w\s+]++)\s*\.?!{1,2}\s*(?:\n|$)"""
)

VULNERABILITY_RULES: tuple[Rule, ...] = (
    # Every language
    _v("SQL-001", "SQL Injection Risk", "critical", "CWE-89", None, "gi",
       (("query", "exec"), ("select", "insert", "update", "delete", "drop"), "(", ("'", '"', "`")),
       r"""(\bquery\b|\bexec\b|\bexecute\b)\s*\(\s*[`'"]\s*(SELECT|INSERT|UPDATE|DELETE|DROP)""",
       "A SQL statement is passed as literal text, which invites injection once values are spliced in.",
       "Bind values through placeholders or a prepared statement."),
    _v("SEC-001", "Hardcoded API Key", "critical", "CWE-798", None, "gi",
       (("apikey", "api_key", "api-key", "token"), ("apikey", "api_key", "api-key", "access", "auth"), (":", "="), ("'", '"', "`")),
       r"""(?:api[_-]?key|apikey|access[_-]?token|auth[_-]?token)\s*[:=]\s*['"`][A-Za-z0-9_-]{20,}['"`]""",
       "A long API key or token value is assigned in the source text.",
       "Load the value from the environment or from a vault."),
    _v("SEC-002", "Hardcoded Password", "critical", "CWE-798", None, "gi",
       (("password", "passwd", "pwd", "secret"), (":", "="), ("'", '"', "`")),
       r"""(?:password|passwd|pwd|secret)\s*[:=]\s*['"`][^'"`\s]{6,}['"`]""",
       "A password or secret value is assigned in the source text.",
       "Ask for it at run time, or read it from a secret store."),
    _v("SEC-003", "AWS Access Key Pattern", "critical", "CWE-798", None, "g",
       (("akia", "asia"),),
       r"""\b(?:AKIA|ASIA)[0-9A-Z]{16}\b""",
       "The text holds what looks like an AWS access key id.",
       "Rotate the key and use a role or the environment in its place.", in_string=True),
    _v("SEC-004", "Google API Key Pattern", "critical", "CWE-798", None, "g",
       ("aiza",),
       r"""\bAIza[0-9A-Za-z_-]{35}\b""",
       "The text holds what looks like a Google API key.",
       "Revoke the key in the cloud console and keep its successor out of the code.", in_string=True),
    _v("SEC-005", "Private Key Block", "critical", "CWE-321", None, "g",
       ("key", "-----begin "),
       r"""-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED |PGP )?PRIVATE KEY(?: BLOCK)?-----""",
       "A PEM private key is part of the source text.",
       "Delete it from history, issue a new key and store that one outside the repository.", in_string=True),
    _v("SEC-006", "GitHub Token Pattern", "critical", "CWE-798", None, "g",
       (("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"),),
       r"""\b(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{50,})\b""",
       "The text holds what looks like a GitHub token.",
       "Revoke the token and inject a new one through CI secrets or the environment.", in_string=True),
    _v("SEC-007", "Slack Token Pattern", "high", "CWE-798", None, "g",
       ("xox",),
       r"""\bxox[abprs]-[A-Za-z0-9-]{10,}\b""",
       "The text holds what looks like a Slack token.",
       "Revoke the token and keep its successor in a secret store.", in_string=True),
    _v("SEC-008", "Azure Storage Account Key", "critical", "CWE-798", None, "g",
       ("key", "accountkey="),
       r"""AccountKey=[A-Za-z0-9+/]{40,}={0,2}""",
       "A storage connection string carries its account key.",
       "Rotate the key; prefer a managed identity or a key vault.", in_string=True),
    _v("NET-001", "Insecure HTTP Protocol", "medium", "CWE-319", None, "g",
       ("http://",),
       r"""['"`]http:\/\/(?!localhost|127\.0\.0\.1|0\.0\.0\.0|www\.w3\.org|schemas?\.|xml\.)""",
       "A plain-text URL sends data over the wire unprotected.",
       "Switch the endpoint to HTTPS."),
    _v("EVAL-001", "eval() Usage", "critical", "CWE-95", None, "g",
       ("eval", "("),
       r"""\beval\s*\(""",
       "Text is executed as code.",
       "Parse the data with a dedicated parser and drop the dynamic evaluation."),
    # JavaScript and TypeScript
    _v("CMD-001", "Command Injection Risk (JS/TS)", "critical", "CWE-78", JS, "g",
       (("exec", "spawn"), "${"),
       r"""\b(exec|execSync|spawn|spawnSync)\s*\(\s*[`'"].*\$\{""",
       "A child process command line is assembled from an interpolated literal.",
       "Pass the program and an argument list, without a shell."),
    _v("XSS-001", "Cross-Site Scripting (innerHTML)", "high", "CWE-79", JS, "g",
       ("innerhtml",),
       r"""\.innerHTML\s*=\s*(?!['"`]\s*['"`])""",
       "Markup is assigned to an element, so untrusted content can run script.",
       "Assign textContent, or clean the markup first."),
    _v("XSS-002", "React dangerouslySetInnerHTML", "high", "CWE-79", JS, "g",
       ("innerhtml", "dangerouslysetinnerhtml"),
       r"""dangerouslySetInnerHTML\s*=\s*\{\s*\{""",
       "A component injects raw markup past the framework's escaping.",
       "Clean the markup before it is injected."),
    _v("XSS-003", "document.write Usage", "high", "CWE-79", JS, "g",
       ("document.write",),
       r"""document\.write\s*\(""",
       "Writing into the document stream can introduce script.",
       "Create and append DOM nodes."),
    _v("EVAL-002", "Function Constructor (JS)", "high", "CWE-95", JS, "g",
       ("function", "new"),
       r"""new\s+Function\s*\(""",
       "A function is compiled from text at run time.",
       "Replace it with ordinary code or a lookup table."),
    _v("PATH-001", "Path Traversal Risk (Node.js)", "high", "CWE-22", JS, "g",
       ("readfile", ".."),
       r"""readFile(?:Sync)?\s*\([^)]*\.\.[/\\]""",
       "A file is read through a path that climbs to a parent folder.",
       "Resolve the path and check that it stays below an allowed root."),
    _v("PROTO-001", "Prototype Pollution Risk", "high", "CWE-1321", JS, "g",
       (".__proto__",),
       r"""\.__proto__\s*=""",
       "An object's prototype is reassigned.",
       "Use a map, or an object without a prototype."),
    _v("RAND-001", "Insecure Random for Security (JS)", "medium", "CWE-338", JS, "gi",
       ("math.random()",),
       r"""(?:(?:token|secret|password|salt|nonce|csrf|session)[^;\n]{0,80}Math\.random\(\)|Math\.random\(\)[^;\n]{0,80}(?:token|secret|password|salt|nonce|csrf|session))""",
       "A predictable generator feeds a security value.",
       "Use the platform's cryptographic generator."),
    _v("REDIR-001", "Open Redirect Risk (Express)", "high", "CWE-601", JS, "g",
       ("req.", ("redirect", "location")),
       r"""(?:res\.redirect|window\.location\.href|location\.replace)\s*\([^)]*req\.(query|params|body)""",
       "The redirect target comes from the request.",
       "Accept only targets from a fixed list."),
    # Python
    _v("PY-001", "Command Injection: os.system / os.popen", "critical", "CWE-78", PY, "g",
       ("os.",),
       r"""\bos\.(?:system|popen)\s*\([^)]*(?:\+|f['"`]|%\s*\w|\bformat\b)""",
       "A shell command is put together from parts.",
       "Run the program with an argument list and no shell."),
    _v("PY-002", "Command Injection: subprocess shell=True", "critical", "CWE-78", PY, "g",
       ("subprocess.", "shell"),
       r"""\bsubprocess\.\w+\s*\([^)]*shell\s*=\s*True""",
       "A subprocess is started through the shell.",
       "Leave the shell off and pass an argument list."),
    _v("PY-003", "Code Injection: exec() in Python", "critical", "CWE-95", PY, "g",
       ("exec", "("),
       r"""\bexec\s*\(\s*(?!['"`][^'"`\n]*['"`]\s*\))""",
       "Python source built at run time is executed.",
       "Use a parser or a table of functions."),
    _v("PY-004", "Insecure Deserialization: pickle", "critical", "CWE-502", PY, "g",
       ("pickle.load",),
       r"""\bpickle\.loads?\s*\(""",
       "Unpickling can run code chosen by whoever wrote the bytes.",
       "Exchange data in a plain format and never unpickle foreign input."),
    _v("PY-005", "Unsafe YAML Loading", "high", "CWE-502", PY, "g",
       ("yaml.load",),
       r"""\byaml\.load\s*\([^)]*(?!\bLoader\s*=\s*yaml\.(?:Safe|Base)Loader)""",
       "The full YAML loader can build arbitrary objects.",
       "Call the safe loader."),
    _v("PY-006", "SQL Injection via String Formatting (Python)", "critical", "CWE-89", PY, "g",
       (".execute",),
       r"""(?:cursor|conn|connection|session|db)\.execute\s*\(\s*(?:f['"`]|['"`][^'"`\n]*['"`]\s*(?:%\s*\w|\+))""",
       "A SQL statement is formatted from values.",
       "Hand the values to execute as parameters."),
    _v("PY-007", "Weak Hash Algorithm (Python)", "high", "CWE-327", PY, "gi",
       ("hashlib.",),
       r"""\bhashlib\.(?:md5|sha1)\s*\([^)]*(?:password|passwd|pwd|secret)""",
       "A broken digest protects a password.",
       "Use a password hash such as bcrypt, argon2 or PBKDF2."),
    _v("PY-008", "Django DEBUG=True", "medium", "CWE-209", PY, "g",
       ("debug",),
       r"""\bDEBUG\s*=\s*True\b""",
       "Debug mode shows traces and settings to visitors.",
       "Turn it off and steer it from the environment."),
    _v("PY-009", "Insecure Random for Security (Python)", "medium", "CWE-338", PY, "g",
       ("random.",),
       r"""\brandom\.(?:random|randint|choice|shuffle|sample)\s*\([^)]*\)""",
       "This generator is predictable.",
       "Take security values from the secrets module."),
    # Java
    _v("JAVA-001", "Command Injection: Runtime.exec()", "critical", "CWE-78", JAVA, "g",
       ("runtime.getruntime",),
       r"""Runtime\.getRuntime\s*\(\s*\)\.exec\s*\(""",
       "A command line is handed to the operating system.",
       "Use a process builder with separate, checked arguments."),
    _v("JAVA-002", "SQL Injection via String Concatenation (Java)", "critical", "CWE-89", JAVA, "g",
       ((".execute", ".preparestatement"),),
       r"""\.(?:execute|executeQuery|executeUpdate|prepareStatement)\s*\(\s*['"`][^'"`\n]*['"`]\s*\+""",
       "A SQL statement is concatenated.",
       "Bind the values on a prepared statement."),
    _v("JAVA-003", "Insecure Deserialization: ObjectInputStream", "critical", "CWE-502", JAVA, "g",
       ("objectinputstream",),
       r"""new\s+ObjectInputStream\s*\(""",
       "Java deserialization can run code from the stream.",
       "Exchange JSON or XML and validate it."),
    _v("JAVA-004", "Weak Hash Algorithm (Java)", "high", "CWE-327", JAVA, "gi",
       ("messagedigest.getinstance",),
       r"""MessageDigest\.getInstance\s*\(\s*['"`](?:MD5|SHA-1|SHA1)['"`]""",
       "A broken digest algorithm is requested.",
       "Ask for SHA-256 or better; hash passwords with bcrypt or PBKDF2."),
    _v("JAVA-005", "XXE: Unsafe XML Parser (Java)", "high", "CWE-611", JAVA, "g",
       ("documentbuilderfactory.newinstance",),
       r"""DocumentBuilderFactory\.newInstance\s*\(\s*\)(?![^;]{0,300}setFeature)""",
       "The XML parser is created with external entities still enabled.",
       "Forbid document type declarations on the factory."),
    _v("JAVA-006", "Insecure Random (Java)", "medium", "CWE-338", JAVA, "g",
       ("random",),
       r"""\bnew\s+Random\s*\(\s*\)""",
       "This generator is predictable.",
       "Use SecureRandom."),
    # C#
    _v("CS-001", "Command Injection: Process.Start (C#)", "critical", "CWE-78", CS, "g",
       ("process.start",),
       r"""Process\.Start\s*\([^)]*(?:\+|string\.Format|interpolat|\$['"`])""",
       "A process is started from a composed string.",
       "Set file name and arguments separately and check them."),
    _v("CS-002", "SQL Injection via String Concatenation (C#)", "critical", "CWE-89", CS, "g",
       ("sqlcommand",),
       r"""new\s+SqlCommand\s*\(\s*(?:['"`][^'"`\n]*['"`]\s*\+|\$['"`])""",
       "A SQL command is concatenated or interpolated.",
       "Add the values as parameters."),
    _v("CS-003", "Insecure Deserialization: BinaryFormatter (C#)", "critical", "CWE-502", CS, "g",
       ("binaryformatter",),
       r"""new\s+BinaryFormatter\s*\(\s*\)""",
       "The binary formatter can run code while reading.",
       "Use a text serializer with a schema."),
    _v("CS-004", "Weak Hash Algorithm (C#)", "high", "CWE-327", CS, "g",
       (("md5cryptoserviceprovider", "sha1"),),
       r"""new\s+(?:MD5CryptoServiceProvider|SHA1(?:CryptoServiceProvider|Managed))\s*\(\s*\)""",
       "A broken digest algorithm is created.",
       "Use SHA-256, or a key derivation function for passwords."),
    _v("CS-005", "Insecure Random (C#)", "medium", "CWE-338", CS, "gi",
       ("random",),
       r"""\bnew\s+Random\s*\(\s*\)(?:[^;]{0,120}(?:token|secret|password|key|nonce|csrf|session))""",
       "A predictable generator feeds a security value.",
       "Use the cryptographic generator."),
    # C and C++
    _v("C-001", "Buffer Overflow: gets()", "critical", "CWE-120", C, "g",
       ("gets",),
       r"""\bgets\s*\(""",
       "The call cannot limit what it reads.",
       "Call fgets with the buffer's size."),
    _v("C-002", "Buffer Overflow: strcpy / strcat", "high", "CWE-120", C, "g",
       (("strcpy", "strcat"),),
       r"""\bstr(?:cpy|cat)\s*\(""",
       "The copy ignores the size of its target.",
       "Use a variant that takes the size."),
    _v("C-003", "Format String / Buffer Overflow: sprintf", "high", "CWE-120", C, "g",
       ("sprintf",),
       r"""\b(?:sprintf|vsprintf)\s*\(""",
       "Formatted output ignores the size of its target.",
       "Use snprintf with the size."),
    _v("C-004", "Command Injection: system()", "critical", "CWE-78", C, "g",
       ("system",),
       r"""\bsystem\s*\(\s*(?!\s*['"`][^'"`\n]*['"`]\s*\))""",
       "A shell command is composed at run time.",
       "Call an exec function with an argument vector."),
    _v("C-005", "Buffer Overflow: scanf %s Without Width", "high", "CWE-120", C, "g",
       ("scanf", "%s"),
       r"""\b(?:scanf|fscanf)\s*\(\s*['"`][^'"`\n]*(?<!\d)%s""",
       "The conversion reads a word of any length.",
       "State the width in the conversion."),
    _v("C-006", "Insecure Random: rand() for Security", "medium", "CWE-338", C, "gi",
       ("rand",),
       r"""(?:(?:token|secret|password|key|salt|nonce)[^;\n]{0,60}\brand\s*\(|\brand\s*\(\)[^;\n]{0,60}(?:token|secret|password|key|salt|nonce))""",
       "A predictable generator feeds a security value.",
       "Read from the kernel's random source."),
    # PHP
    _v("PHP-001", "Code Injection: eval() in PHP", "critical", "CWE-95", PHP, "g",
       ("eval",),
       r"""\beval\s*\(\s*(?!\s*['"`][^'"`\n]*['"`]\s*\))""",
       "PHP source built at run time is executed.",
       "Dispatch through a table of functions."),
    _v("PHP-002", "Command Injection (PHP)", "critical", "CWE-78", PHP, "g",
       (("exec", "system", "passthru", "popen"),),
       r"""\b(?:shell_exec|system|exec|passthru|popen)\s*\([^)]*(?:\$_(?:GET|POST|REQUEST|COOKIE|SERVER)|[$\w]+\s*\.)""",
       "Request data or a concatenation reaches a shell.",
       "Escape each argument, or avoid the shell."),
    _v("PHP-003", "SQL Injection via Superglobals (PHP)", "critical", "CWE-89", PHP, "g",
       ("query", "$_"),
       r"""(?:mysql_query|mysqli_query|pg_query|->query)\s*\([^)]*\$_(?:GET|POST|REQUEST|COOKIE)""",
       "Request data is spliced into a query.",
       "Bind it as a parameter."),
    _v("PHP-004", "Deprecated mysql_* Functions (PHP)", "high", "CWE-89", PHP, "g",
       ("mysql_",),
       r"""\bmysql_(?:query|connect|select_db|real_escape_string)\s*\(""",
       "The old database functions were removed and are unsafe.",
       "Move to PDO or mysqli with prepared statements."),
    _v("PHP-005", "Weak Hash for Passwords (PHP)", "high", "CWE-327", PHP, "gi",
       (("md5", "sha1"),),
       r"""\b(?:md5|sha1)\s*\(\s*\$(?:password|passwd|pwd|pass)""",
       "A broken digest protects a password.",
       "Use the password hashing functions."),
    _v("PHP-006", "preg_replace /e Modifier (PHP)", "critical", "CWE-95", PHP, "g",
       ("preg_replace",),
       r"""preg_replace\s*\(\s*['"`][^'"`]*\/e['"`]""",
       "The modifier executes the replacement text.",
       "Use the callback variant."),
    _v("PHP-007", "Open Redirect via header() (PHP)", "high", "CWE-601", PHP, "g",
       ("header", "$_"),
       r"""header\s*\(\s*['"`]Location:\s*['"`]\s*\.\s*\$_(?:GET|POST|REQUEST)""",
       "The redirect target comes from the request.",
       "Accept only targets from a fixed list."),
    _v("PHP-008", "Local File Inclusion (PHP)", "critical", "CWE-98", PHP, "g",
       (("include", "require"), "$_"),
       r"""\b(?:include|require)(?:_once)?\s*\(?[^;]*\$_(?:GET|POST|REQUEST|COOKIE)""",
       "The request decides which file is included.",
       "Map request values to a fixed list of files."),
    # Go
    _v("GO-001", "Command Injection: exec.Command (Go)", "critical", "CWE-78", GO, "g",
       ("exec.command",),
       r"""exec\.Command\s*\(\s*(?!\s*['"`][^'"`\n]*['"`])""",
       "The program to run is not a constant.",
       "Choose the program and its arguments from a checked list."),
    _v("GO-002", "Insecure Random: math/rand (Go)", "medium", "CWE-338", GO, "g",
       ("rand",),
       r"""\bmath\/rand\b|rand\.(?:Int|Intn|Float64|Seed)\s*\(""",
       "This generator is predictable.",
       "Import crypto/rand."),
    _v("GO-003", "TLS Verification Disabled (Go)", "critical", "CWE-295", GO, "g",
       ("insecureskipverify",),
       r"""InsecureSkipVerify\s*:\s*true""",
       "Certificates are accepted unchecked.",
       "Drop the setting and supply the right certificate pool."),
    _v("GO-004", "SQL Injection via Concatenation (Go)", "critical", "CWE-89", GO, "g",
       (("db.query", "db.exec"),),
       r"""db\.(?:Query|Exec|QueryRow)\s*\(\s*(?:['"`][^'"`\n]*['"`]\s*\+|fmt\.Sprintf)""",
       "A SQL statement is concatenated or formatted.",
       "Use placeholders."),
    # Ruby
    _v("RB-001", "Command Injection (Ruby)", "critical", "CWE-78", RB, "g",
       ("#{",),
       r"""(?:`[^`]*#\{|\bsystem\s*\([^)]*#\{|\bexec\s*\([^)]*#\{|\bIO\.popen\s*\([^)]*#\{)""",
       "A shell command contains interpolated values.",
       "Pass arguments one by one, or escape them."),
    _v("RB-002", "Code Injection: eval() (Ruby)", "critical", "CWE-95", RB, "g",
       ("eval",),
       r"""\beval\s*\(\s*(?!\s*['"`][^'"`\n]*['"`]\s*\))""",
       "Ruby source built at run time is executed.",
       "Define methods or dispatch explicitly."),
    _v("RB-003", "Unsafe YAML Loading (Ruby)", "high", "CWE-502", RB, "g",
       ("yaml.",),
       r"""YAML\.(?:load|unsafe_load)\s*\(""",
       "The loader can build arbitrary objects.",
       "Call the safe loader."),
    _v("RB-004", "Insecure Deserialization: Marshal.load (Ruby)", "critical", "CWE-502", RB, "g",
       ("marshal.",),
       r"""Marshal\.(?:load|restore)\s*\(""",
       "Unmarshalling can run code from the bytes.",
       "Exchange JSON."),
    _v("RB-005", "SQL Injection via String Interpolation (Ruby/Rails)", "critical", "CWE-89", RB, "g",
       ("#{",),
       r"""\.(?:where|find_by_sql|execute|select|joins)\s*\(\s*['"`][^'"`\n]*#\{""",
       "A query condition contains interpolated values.",
       "Pass the values as bind arguments."),
    # Rust
    _v("RUST-001", "Unsafe Block (Rust)", "medium", "CWE-119", RS, "g",
       ("unsafe",),
       r"""\bunsafe\s*\{""",
       "The compiler's memory checks are off in this block.",
       "Keep the block small and write down what makes it sound."),
    _v("RUST-002", "Command Injection: Command::new (Rust)", "critical", "CWE-78", RS, "g",
       ("command::new",),
       r"""Command::new\s*\([^)]*(?:format!|&\w+\b)(?!\s*['"`])""",
       "The program to run is composed at run time.",
       "Choose it from a list and add checked arguments one by one."),
    # Kotlin
    _v("KT-001", "Command Injection: Runtime.exec() (Kotlin)", "critical", "CWE-78", KT, "g",
       ("runtime.getruntime",),
       r"""Runtime\.getRuntime\s*\(\s*\)\.exec\s*\(""",
       "A command line is handed to the operating system.",
       "Use a process builder with separate, checked arguments."),
    _v("KT-002", "Weak Hash Algorithm (Kotlin)", "high", "CWE-327", KT, "gi",
       ("messagedigest.getinstance",),
       r"""MessageDigest\.getInstance\s*\(\s*['"`](?:MD5|SHA-1|SHA1)['"`]""",
       "A broken digest algorithm is requested.",
       "Ask for SHA-256 or better; hash passwords with bcrypt."),
    # Swift
    _v("SWIFT-001", "Command Injection: Process() (Swift)", "high", "CWE-78", SWIFT, "g",
       ("process", ("launchpath", "arguments")),
       r"""\bProcess\s*\(\s*\)(?:[^;]{0,200}launchPath|[^;]{0,200}arguments)""",
       "A process is set up with run-time arguments.",
       "Check every argument against a list first."),
    _v("SWIFT-002", "Weak Hash Algorithm (Swift)", "high", "CWE-327", SWIFT, "g",
       (("cc_md5", "cc_sha1", "insecure."),),
       r"""\b(?:CC_MD5|CC_SHA1|Insecure\.MD5|Insecure\.SHA1)\b""",
       "A broken digest algorithm is used.",
       "Use SHA-256 or better."),
    # Shell
    _v("SH-001", "Remote Code Execution: curl|bash", "critical", "CWE-494", SH, "g",
       ("curl", "|"),
       r"""curl\s+[^|#\n]*\|\s*(?:bash|sh|zsh|python|ruby|perl|node)\b""",
       "Downloaded text is run unseen.",
       "Download, compare the checksum, then run."),
    _v("SH-002", "Code Injection: eval with Variable (Shell)", "critical", "CWE-78", SH, "g",
       ("eval", "$"),
       r"""\beval\s+(?:\$|['"`].*\$)""",
       "A variable is evaluated as a command.",
       "Keep commands in arrays."),
    # Dart
    _v("DART-001", "Command Injection: Process.run/start (Dart)", "critical", "CWE-78", DART, "g",
       (("process.run", "process.start"),),
       r"""Process\.(?:run|start)\s*\([^)]*(?:\+|\$\{|\bexecutable\b)""",
       "A process is started with composed arguments.",
       "Fix the program name and check the arguments."),
    # Scala
    _v("SCALA-001", "SQL Injection via String Interpolation (Scala)", "critical", "CWE-89", SCALA, "g",
       ((".execute", ".preparestatement"),),
       r"""\.(?:execute|executeQuery|executeUpdate|prepareStatement)\s*\(\s*s['"`]""",
       "A SQL statement is interpolated.",
       "Use a query library or bind parameters."),
    _v("SCALA-002", "Command Injection: sys.process (Scala)", "high", "CWE-78", SCALA, "gm",
       ("!",),
       r"""(?:s['"`][^'"`\n]*['"`]|[\w\s+]+)\s*\.?!{1,2}\s*(?:\n|$)""",
       "A string is run as a shell command.",
       "Run a sequence of program and arguments.", linear=_SCALA_PROCESS_LINEAR),
    # Terraform
    _v("TF-001", "Terraform: Wildcard IAM Permission", "critical", "CWE-732", TF, "g",
       ('"action"',),
       r'''"Action"\s*:\s*"\*"''',
       "The policy allows every action.",
       "List the actions that are needed."),
    _v("TF-002", "Terraform: Open Ingress (0.0.0.0/0)", "high", "CWE-284", TF, "g",
       ("cidr_blocks",),
       r"""cidr_blocks\s*=\s*\["0\.0\.0\.0\/0"\]""",
       "The security group admits the whole internet.",
       "Name the address ranges that need access."),
    _v("TF-003", "Terraform: Public S3 Bucket ACL", "critical", "CWE-732", TF, "g",
       ("acl",),
       r'''acl\s*=\s*"public-read(?:-write)?"''',
       "The bucket is readable by everyone.",
       "Make it private and grant access by policy."),
    _v("TF-004", "Terraform: Unencrypted RDS Storage", "high", "CWE-312", TF, "g",
       ("storage_encrypted",),
       r"""storage_encrypted\s*=\s*false""",
       "Database storage is not encrypted.",
       "Turn encryption on."),
    _v("TF-005", "Terraform: Hardcoded Secret in Provider", "critical", "CWE-798", TF, "g",
       (("access_key", "secret_key", "password", "token"),),
       r'''(?:access_key|secret_key|password|token)\s*=\s*"[A-Za-z0-9+/=_-]{8,}"''',
       "A credential stands in the configuration.",
       "Read it from the environment or a vault."),
    _v("TF-006", "Terraform: Skip TLS Verification", "high", "CWE-295", TF, "g",
       ("skip_tls_verify",),
       r"""skip_tls_verify\s*=\s*true""",
       "Certificates are accepted unchecked.",
       "Remove the setting."),
    # Dockerfile
    _v("DOCKER-001", "Dockerfile: Running as Root", "high", "CWE-250", DOCKER, "gm",
       ("user",),
       r"""^USER\s+root\s*$""",
       "The container runs with full rights.",
       "Create an unprivileged user and switch to it."),
    _v("DOCKER-002", "Dockerfile: Unpinned Image Tag (latest)", "medium", None, DOCKER, "gi",
       (":latest",),
       r"""FROM\s+\S+:latest\b""",
       "The base image changes without notice.",
       "Pin a version or a digest."),
    _v("DOCKER-003", "Dockerfile: ADD Instead of COPY", "medium", None, DOCKER, "gm",
       ("add",),
       r"""^ADD\s+(?!http)""",
       "The instruction unpacks archives and fetches addresses on its own.",
       "Use COPY for local files."),
    _v("DOCKER-004", "Dockerfile: Hardcoded Secret in ENV", "critical", "CWE-798", DOCKER, "gim",
       ("env",),
       r"""^ENV\s+\S*(?:PASSWORD|SECRET|TOKEN|KEY|API_KEY)\S*\s+\S+""",
       "The secret stays readable in the image layers.",
       "Use build secrets or pass it at run time."),
    # Kubernetes
    _v("K8S-001", "Kubernetes: Privileged Container", "critical", "CWE-250", YAML, "g",
       ("privileged",),
       r"""privileged\s*:\s*true""",
       "The container has root access to its host.",
       "Grant single capabilities."),
    _v("K8S-002", "Kubernetes: Host Network Access", "high", "CWE-284", YAML, "g",
       ("hostnetwork",),
       r"""hostNetwork\s*:\s*true""",
       "The pod shares the host's network.",
       "Remove the setting."),
    _v("K8S-003", "Kubernetes: Allow Privilege Escalation", "high", "CWE-269", YAML, "g",
       ("allowprivilegeescalation",),
       r"""allowPrivilegeEscalation\s*:\s*true""",
       "Processes may gain rights beyond their parent's.",
       "Set it to false."),
    _v("K8S-004", "Kubernetes: No Resource Limits", "medium", "CWE-400", YAML, "g",
       ("containers:", "image:"),
       r"""containers:[\s\S]{0,500}image:\s*\S+(?![\s\S]{0,300}resources:)""",
       "Nothing limits what the container may use up.",
       "State requests and limits for each container."),
    # Pipelines
    _v("CICD-001", "CI/CD: Hardcoded Secret in Pipeline", "critical", "CWE-798", YAML, "gi",
       (("password", "token", "secret", "api_key", "apikey"),),
       r"""(?:password|token|secret|api_key|apikey)\s*:\s*(?!"\$\{\{)["'][A-Za-z0-9+/=_-]{8,}["']""",
       "A secret stands in the pipeline definition.",
       "Reference the pipeline's secret store."),
    _v("CICD-002", "CI/CD: pull_request_target Without Permissions", "high", "CWE-284", YAML, "g",
       ("pull_request_target",),
       r"""on:\s*[\s\S]*pull_request_target""",
       "Code from a fork runs with write permission.",
       "Limit the permissions, or use the plain trigger."),
    _v("CICD-003", "CI/CD: Unverified Script Piped to Shell", "critical", "CWE-494", YAML, "g",
       ("curl", "|"),
       r"""curl\s+[^|]*\|\s*(?:bash|sh|python|ruby)""",
       "A downloaded script is run unseen.",
       "Download, compare the checksum, then run."),
)
