"""A small lexicon as rows (kind, name, pattern) for the queries; operators take a lexicon as an argument."""

from __future__ import annotations

#: Families made up for these queries, in the part of the pattern language that Java and RE2 share.
LEXICON = (
    ("density", "agency", r"(?i)\b(?:carry|gave|give|move|open|pull|push|reach|step|take|took)\w*"),
    ("density", "conflict", r"(?i)\b(?:blame|insult|oppos|quarrel|resist|rival|shout|strike|struck)\w*"),
    ("density", "interiority", r"(?i)\b(?:belie|doubt|dream|joy|memor|mind|regret|sorrow|suspect)\w*"),
    ("sense", "sight", r"(?i)\b(?:gaze|glitter|glow|shadow|watch)\w*"),
    ("sense", "sound", r"(?i)\b(?:drum|echo|murmur|quiet|ring)\w*"),
    ("sense", "touch", r"(?i)\b(?:damp|grip|sharp|skin|velvet)\w*"),
    ("sense", "smell", r"(?i)\b(?:fragran|musk|reek|resin|soot)\w*"),
    ("sense", "taste", r"(?i)\b(?:honey|lemon|spice|sugar|vinegar)\w*"),
)
