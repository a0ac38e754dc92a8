"""Malicious-code rules (every file type).

Fixed values: ids, titles, patterns, flags, severities and sub-categories.
"""

from __future__ import annotations

from codewarden.catalog.model import Rule

CONFIDENCE = 0.80


def _m(rule_id, title, severity, sub, flags, needs, pattern, description, advice):
    return Rule(
        rule_id=rule_id, title=title, severity=severity, pattern=pattern, flags=flags, needs=needs,
        description=description, recommendation=advice, category="malicious", sub_category=sub,
        confidence=CONFIDENCE,
    )


MALICIOUS_RULES: tuple[Rule, ...] = (
    _m("KL-001", "Keylogger Pattern: keydown Listener", "critical", "keylogger", "gi",
       ("key", ("fetch", "xmlhttprequest", "sendbeacon", "ajax"), "keydown"),
       r"""addEventListener\s*\(\s*['"`]keydown['"`][^)]*\)\s*\{[^}]*(?:fetch|XMLHttpRequest|sendBeacon|ajax)""",
       "A key listener also sends data away.",
       "Find out what is collected; remove the listener if nobody can explain it."),
    _m("KL-002", "Keylogger Pattern: keystroke capture", "critical", "keylogger", "gi",
       ("key", "keylog"),
       r"""(?:keyCode|which|key)\s*.*(?:fetch|xhr|send|post)\s*\([^)]*keylog""",
       "Key strokes are sent to a remote address.",
       "Remove the collection and investigate."),
    _m("EXFIL-001", "Credential Exfiltration", "critical", "data-exfiltration", "gi",
       (("fetch", "xmlhttprequest", "sendbeacon", "axios.post"),
        ("passw", "credential", "token", "key", "secret"), ";", "="),
       r"""(?:password|passwd|credential|token|apikey|secret)[^=]*=\s*[^;]+;\s*(?:fetch|XMLHttpRequest\.prototype\.send|sendBeacon|axios\.post)""",
       "A credential is captured and sent out in the next statement.",
       "Treat it as hostile: remove it and audit the sign-in flow."),
    _m("EXFIL-002", "Local Storage Exfiltration", "high", "data-exfiltration", "gi",
       (("fetch", "xmlhttprequest", "sendbeacon"), "localstorage.getitem"),
       r"""localStorage\.getItem[^;]*(?:fetch|sendBeacon|XMLHttpRequest)""",
       "Stored browser data is sent out.",
       "Check that a feature really needs this."),
    _m("EXFIL-003", "Cookie Exfiltration", "critical", "data-exfiltration", "gi",
       ("document.cookie",),
       r"""(?:document\.cookie[^;]*(?:fetch|sendBeacon|XMLHttpRequest|image\.src)|(?:fetch|sendBeacon|new XMLHttpRequest)\s*\([^;]*document\.cookie)""",
       "Cookies are sent out, which gives the session away.",
       "Remove it and mark session cookies HttpOnly."),
    _m("FORM-001", "Form Submit Hijacking", "critical", "form-hijacking", "gi",
       (("fetch", "xmlhttprequest"), "submit"),
       r"""addEventListener\s*\(\s*['"`]submit['"`][^)]*\)\s*\{[^}]*(?:fetch|XMLHttpRequest)[^}]*(?:password|email|credit|card|ssn)""",
       "A submit listener forwards sensitive fields.",
       "Looks like a skimmer: remove it and audit every payment form."),
    _m("FORM-002", "Input Field Monitoring", "high", "form-hijacking", "gi",
       ("query", "queryselectorall"),
       r"""querySelectorAll\s*\(\s*['"`]input\[type=['"](password|text|email|tel)""",
       "All sensitive input fields are collected.",
       "Check the purpose; skimmers start this way."),
    _m("MINER-001", "Crypto Mining Code (CoinHive-style)", "critical", "crypto-miner", "gi",
       (("mine", "coin", "cryptoloot"),),
       r"""(?:coinhive|cryptoloot|deepminer|jsecoin|minero|webminepool)\.(?:Anonymous|User|mine|start)""",
       "A known mining library is started.",
       "Remove it."),
    _m("MINER-002", "WebAssembly Mining Pattern", "medium", "crypto-miner", "gi",
       ("webassembly.instantiate",),
       r"""WebAssembly\.instantiate[^;]*(?:fetch|import)[^;]*\.wasm""",
       "A fetched binary module is instantiated; it might mine.",
       "Find out where the module comes from."),
    _m("CLIP-001", "Clipboard Hijacking", "high", "clipboard-hijack", "gi",
       ("clipboarddata.setdata",),
       r"""addEventListener\s*\(\s*['"`]copy['"`][^)]*\)\s*\{[^}]*clipboardData\.setData""",
       "Copied text is replaced on its way to the clipboard.",
       "Remove it unless it is a deliberate formatting feature."),
    _m("OBF-001", "Code Obfuscation Detected", "critical", "obfuscation", "g",
       (("eval", "string.fromcharcode("), ("atob", "unescape", "decodeuricomponent", "string.fromcharcode(")),
       r"""(?:eval\s*\(atob|eval\s*\(unescape|eval\s*\(decodeURIComponent|String\.fromCharCode\([0-9,\s]{50,}\))""",
       "Decoded text is evaluated, a common way to hide malware.",
       "Decode it and read what it does."),
    _m("OBF-002", "Hex-encoded Script Injection", "high", "obfuscation", "gi",
       ("\\x",),
       r"""\\x[0-9a-f]{2}(\\x[0-9a-f]{2}){10,}""",
       "A long run of hex escapes hides its content.",
       "Decode it and read what it does."),
    _m("TRACK-001", "Browser Fingerprinting", "medium", "tracking", "gi",
       (("fetch", "sendbeacon"),
        ("navigator.plugins", "navigator.mimetypes", "screen.colordepth", "canvas.todataurl",
         "audiocontext", "rtcpeerconnection")),
       r"""(?:navigator\.plugins|navigator\.mimeTypes|screen\.colorDepth|canvas\.toDataURL|AudioContext|RTCPeerConnection)[^;]{0,100}(?:fetch|sendBeacon)""",
       "Traits of the browser are collected and sent out.",
       "Say so in the privacy notice and ask for consent."),
    _m("IFRAME-001", "Invisible Iframe Injection", "high", "data-exfiltration", "gi",
       ("<iframe", "src", ("width", "height", "style")),
       r"""<iframe\b(?=[^>]*\bsrc\s*=\s*['"][^'"]{1,}['"])(?=[^>]*(?:(?:width|height)\s*=\s*["']?0["']?|style\s*=\s*["'][^"']*(?:width\s*:\s*0|height\s*:\s*0|display\s*:\s*none)))[^>]*""",
       "A frame with a source is kept out of sight.",
       "Remove frames that point elsewhere and cannot be seen."),
)
