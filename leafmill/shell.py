"""What a shell wants to know of the command line: completions and manual pages, made from the argument parser."""

from __future__ import annotations

import argparse
import os

SHELLS = ("bash", "elvish", "fish", "powershell", "zsh")


def commands(parser: argparse.ArgumentParser) -> dict[str, argparse.ArgumentParser]:
    """The commands of a parser by their names and aliases."""
    return next(a.choices for a in parser._actions if isinstance(a, argparse._SubParsersAction))


def options(command: argparse.ArgumentParser) -> list[str]:
    return sorted(o for a in command._actions for o in a.option_strings)


def completion(parser: argparse.ArgumentParser, shell: str) -> str:
    """A script that completes commands and, behind a command, its options."""
    found, name = commands(parser), parser.prog
    if shell == "fish":
        lines = [f"complete -c {name} -n __fish_use_subcommand -f -a {c}" for c in found]
        for c, own in found.items():
            for o in options(own):
                kind = f"-l {o[2:]}" if o.startswith("--") else f"-s {o[1:]}"
                lines.append(f"complete -c {name} -n '__fish_seen_subcommand_from {c}' {kind}")
        return "\n".join(lines) + "\n"
    if shell == "powershell":
        table = "; ".join(f"'{c}' = @({', '.join(repr(o) for o in options(own))})" for c, own in found.items())
        return (
            f"Register-ArgumentCompleter -Native -CommandName {name} -ScriptBlock {{\n  param($word, $ast, $at)\n  $known = @{{ {table} }}\n  $said = @($ast.CommandElements | ForEach-Object {{ $_.ToString() }})\n"
            "  $all = if ($said.Count -gt 1 -and $known.ContainsKey($said[1])) { $known[$said[1]] } else { $known.Keys }\n  $all | Where-Object { $_ -like \"$word*\" }\n}\n"
        )
    if shell == "elvish":
        table = " ".join(f"&{c}=[{' '.join(options(own))}]" for c, own in found.items())
        return f"var known = [{table}]\nset edit:completion:arg-completer[{name}] = {{|@said|\n  if (and (> (count $said) 2) (has-key $known $said[1])) {{ all $known[$said[1]] }} else {{ keys $known }}\n}}\n"
    cases = "\n".join(f'    {c}) words="{" ".join(options(own))}" ;;' for c, own in found.items())
    function = f'_{name}() {{\n  local words="{" ".join(found)}"\n  [ "$COMP_CWORD" -gt 1 ] && case "${{COMP_WORDS[1]}}" in\n{cases}\n  esac\n  COMPREPLY=($(compgen -W "$words" -- "${{COMP_WORDS[COMP_CWORD]}}"))\n}}\ncomplete -o default -F _{name} {name}\n'
    return function if shell == "bash" else f"autoload -U +X compinit && compinit\nautoload -U +X bashcompinit && bashcompinit\n{function}"


def _roff(text: str) -> str:
    return text.replace("\\", "\\e").replace("-", "\\-").replace("\n.", "\n\\&.")


def manual(name: str, own: argparse.ArgumentParser, others: list[str]) -> str:
    """A manual page in roff."""
    lines = [f'.TH "{name.upper()}" "1"', ".SH NAME", _roff(name), ".SH SYNOPSIS", _roff(" ".join(own.format_usage().split()[1:])), ".SH OPTIONS"]
    for action in own._actions:
        if isinstance(action, argparse._SubParsersAction):
            continue
        said = ", ".join(action.option_strings) or action.dest
        if action.choices:
            said += f" ({', '.join(map(str, action.choices))})" if len(list(action.choices)) < 20 else ""
        lines += [".TP", f"\\fB{_roff(said)}\\fR", _roff(action.help or action.dest.strip("_").replace("_", " "))]
    if others:
        lines += [".SH SEE ALSO", ", ".join(f"\\fB{_roff(o)}\\fR(1)" for o in others)]
    return "\n".join(lines) + "\n"


def write_manuals(parser: argparse.ArgumentParser, folder: str) -> None:
    """A page for the program and one for each command."""
    os.makedirs(folder, exist_ok=True)
    found = {own.prog.replace(" ", "-"): own for own in commands(parser).values()}
    pages = {parser.prog: manual(parser.prog, parser, sorted(found))} | {n: manual(n, own, [parser.prog]) for n, own in found.items()}
    for name, text in pages.items():
        with open(os.path.join(folder, f"{name}.1"), "w", encoding="utf-8") as out:
            out.write(text)
