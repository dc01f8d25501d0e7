"""LaTeX to plain HTML: letters and operators as characters, scripts and fractions as markup."""

from __future__ import annotations

import re

# Greek letters.
GREEK = {
    "\\alpha": "α", "\\beta": "β", "\\gamma": "γ", "\\delta": "δ", "\\epsilon": "ε", "\\zeta": "ζ", "\\eta": "η", "\\theta": "θ", "\\iota": "ι", "\\kappa": "κ",
    "\\lambda": "λ", "\\mu": "μ", "\\nu": "ν", "\\xi": "ξ", "\\pi": "π", "\\rho": "ρ", "\\sigma": "σ", "\\tau": "τ", "\\upsilon": "υ", "\\phi": "φ", "\\chi": "χ",
    "\\psi": "ψ", "\\omega": "ω",
    "\\Alpha": "Α", "\\Beta": "Β", "\\Gamma": "Γ", "\\Delta": "Δ", "\\Epsilon": "Ε", "\\Zeta": "Ζ", "\\Eta": "Η", "\\Theta": "Θ", "\\Iota": "Ι", "\\Kappa": "Κ",
    "\\Lambda": "Λ", "\\Mu": "Μ", "\\Nu": "Ν", "\\Xi": "Ξ", "\\Pi": "Π", "\\Rho": "Ρ", "\\Sigma": "Σ", "\\Tau": "Τ", "\\Upsilon": "Υ", "\\Phi": "Φ", "\\Chi": "Χ",
    "\\Psi": "Ψ", "\\Omega": "Ω",
}
# Variants of letters, operators and delimiters.
SYMBOLS = GREEK | {
    "\\varepsilon": "ε", "\\vartheta": "ϑ", "\\varpi": "ϖ", "\\varrho": "ϱ", "\\varsigma": "ς", "\\varphi": "ϕ",
    "\\pm": "±", "\\mp": "∓", "\\times": "×", "\\div": "÷", "\\cdot": "·", "\\ne": "≠", "\\neq": "≠", "\\le": "≤", "\\leq": "≤", "\\ge": "≥", "\\geq": "≥",
    "\\approx": "≈", "\\equiv": "≡", "\\sim": "∼", "\\propto": "∝", "\\infty": "∞", "\\partial": "∂", "\\nabla": "∇", "\\forall": "∀", "\\exists": "∃", "\\in": "∈",
    "\\notin": "∉", "\\subset": "⊂", "\\supset": "⊃", "\\subseteq": "⊆", "\\supseteq": "⊇", "\\cup": "∪", "\\cap": "∩", "\\emptyset": "∅", "\\sum": "∑", "\\prod": "∏",
    "\\int": "∫", "\\lim": "lim", "\\to": "→", "\\rightarrow": "→", "\\leftarrow": "←", "\\Rightarrow": "⇒", "\\Leftarrow": "⇐", "\\leftrightarrow": "↔",
    "\\Leftrightarrow": "⇔", "\\therefore": "∴", "\\because": "∵", "\\ldots": "…", "\\cdots": "⋯", "\\quad": "\u2003", "\\qquad": "\u2003\u2003",
    "\\{": "{", "\\}": "}", "\\langle": "⟨", "\\rangle": "⟩", "\\lfloor": "⌊", "\\rfloor": "⌋", "\\lceil": "⌈", "\\rceil": "⌉", "\\|": "‖",
}
_SYMBOL = re.compile("|".join(re.escape(s) for s in sorted(SYMBOLS, key=len, reverse=True) if s not in ("\\{", "\\}")))
_MATH = re.compile(r"\$\$(.+?)\$\$|\\\[(.+?)\\\]", re.DOTALL)
_INLINE = re.compile(r"(?<!\$)\$(?!\$)(.+?)(?<!\$)\$(?!\$)|\\\((.+?)\\\)")


def to_html(expression: str) -> str:
    """One expression without its delimiters."""
    out = re.sub(r"\\(?:text|mathrm|mathit|mathbf)\{([^}]*)\}", r"\1", expression.strip())
    out = re.sub(r"\\frac\{([^}]*)\}\{([^}]*)\}", lambda m: f"({to_html(m[1])})/({to_html(m[2])})", out)
    out = re.sub(r"\\sqrt(?:\[([^\]]*)\])?\{([^}]*)\}", lambda m: f"{m[1] or ''}√{m[2]}", out)
    for mark, tag in (("^", "sup"), ("_", "sub")):
        out = re.sub(rf"\{mark}(?:\{{([^}}]*)\}}|([a-zA-Z0-9]))", lambda m, tag=tag: f"<{tag}>{to_html(m[1]) if m[1] is not None else m[2]}</{tag}>", out)
    out = re.sub(r"\\overline\{([^}]*)\}", r'<span style="text-decoration: overline;">\1</span>', out)
    out = re.sub(r"\\underline\{([^}]*)\}", r"<u>\1</u>", out)
    out = _SYMBOL.sub(lambda m: SYMBOLS[m[0]], out).replace("\\{", "").replace("\\}", "").replace("{", "").replace("}", "")
    return re.sub(r"\s+", " ", out).strip()


def convert_text(text: str) -> str | None:
    """Text with its delimited expressions as HTML spans, or null if there is none."""
    span = lambda m: f'<span role="math" aria-label="{(m[1] or m[2]).strip()}">{to_html(m[1] or m[2])}</span>'
    out = _INLINE.sub(span, _MATH.sub(span, text))
    return out if out != text else None


def remaining(text: str) -> list[str]:
    """LaTeX that is left in a text; amounts of money aren't meant."""
    found = [m[0][:50] for m in re.finditer(r"\$[^$]+\$", text) if not re.match(r"^\$\d+(\.\d{2})?$", m[0])]
    return found + [m[0] for m in re.finditer(r"\\[a-zA-Z]+", text) if m[0] not in ("\\n", "\\t", "\\r")]
