"""File extensions and their languages."""

# Language of each source extension.
LANGUAGES = {
    ".py": "Python", ".pyi": "Python",
    ".js": "JavaScript", ".jsx": "JavaScript", ".mjs": "JavaScript", ".cjs": "JavaScript",
    ".ts": "TypeScript", ".mts": "TypeScript", ".cts": "TypeScript", ".tsx": "TSX",
    ".go": "Go", ".rs": "Rust", ".java": "Java", ".cs": "C#", ".rb": "Ruby", ".rake": "Ruby",
    ".c": "C", ".h": "C",
    ".cpp": "C++", ".cc": "C++", ".cxx": "C++", ".hpp": "C++", ".hh": "C++", ".hxx": "C++",
    ".php": "PHP",
}
