"""Shell command rules, in the order in which they are reported.

Fixed values: issue types, patterns, flags and severities.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ShellRule:
    issue_type: str
    severity: str
    pattern: str
    flags: str
    description: str
    suggestion: str


SHELL_RULES: tuple[ShellRule, ...] = (
    ShellRule("destructive", "critical",
              r"""\brm\s+(?:-{1,2}[a-z-]+\s+)*?(?:-[a-z]*f[a-z]*|--force)\s+(?:-{1,2}[a-z-]+\s+)*[/~$]""", "i",
              "A forced rm on a root, home or variable path can wipe the system.",
              "Write out the exact path and list it before deleting."),
    ShellRule("destructive", "critical",
              r"""\bdd\s+[^|;&\n]*\bif=\/dev\/(?:zero|u?random)\b""", "i",
              "dd fed with zeros or noise can overwrite a disk.",
              "State the byte count and check the target twice."),
    ShellRule("privilege-escalation", "critical",
              r"""\bsudo\s+(?:su|bash|sh|zsh|fish)\b""", "i",
              "A root shell leaves no trace of what is done in it.",
              "Run the single command with sudo."),
    ShellRule("insecure-pipe", "critical",
              r"""curl\s+[^|]*\|\s*(?:bash|sh|zsh|python|perl|ruby|node)""", "i",
              "A remote script goes straight into an interpreter.",
              "Download it, read it, then run it."),
    ShellRule("insecure-pipe", "critical",
              r"""wget\s+[^|]*\|\s*(?:bash|sh|zsh|python)""", "i",
              "A fetched script goes straight into an interpreter.",
              "Save it to a file, read it, then run it."),
    ShellRule("privilege-escalation", "high",
              r"""\bchmod\s+(?:-[a-zA-Z]+\s+)*(?:[0-7]?[0-7]{2}[2367](?![0-7])|(?:[ao]+\+[rxXst]*w[rwxXst]*|a\+rwx))(?=\s|$)""", "",
              "The mode lets every user change the file.",
              "Use 755 for programs and 644 for files."),
    ShellRule("command-injection", "high",
              r"""\$\(|`[^`]*\$[A-Z_]+[^`]*`""", "",
              "A substituted command may run whatever a variable holds.",
              "Quote the variables and check them first."),
    ShellRule("network-exfiltration", "critical",
              r"""(?:curl|wget|nc|netcat)\s+.*\s+(?:\/etc\/passwd|\/etc\/shadow|~\/\.ssh)""", "i",
              "A sensitive system file is sent over the network.",
              "Find out at once who wrote this command."),
    ShellRule("destructive", "critical",
              r""">\s*\/dev\/s[a-z][a-z0-9]|>\s*\/dev\/hd[a-z]""", "",
              "Output is written onto a raw disk.",
              "Do not write to block devices without a backup."),
    ShellRule("privilege-escalation", "medium",
              r"""crontab\s+-[ei]""", "i",
              "Scheduled jobs can be used to stay on a system.",
              "Look through the changed entries."),
    ShellRule("network-exfiltration", "high",
              r"""\bssh\s+.*-R\s+\d+:""", "i",
              "A reverse tunnel opens inner services to the outside.",
              "Have the tunnel approved and watched."),
    ShellRule("destructive", "high",
              r"""\btruncate\s+-s\s+0|:\s*>\s*(?:\/[a-z]+){2,}""", "",
              "The file's content is lost.",
              "Keep a copy first."),
)
