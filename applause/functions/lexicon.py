"""Word lists and patterns. Every operator takes its lists as arguments; these are the defaults."""

from __future__ import annotations

# The domain vocabulary whose matches decide the adjustment rules.
DOMAIN_POSITIVE = [
    "villain", "evil", "brutal", "fight", "battle", "explosion", "dark",
    "intense", "scary", "kill", "die", "death", "worst enemy", "legendary",
    "epic", "insane", "crazy", "sick", "favourite", "favorite", "hype",
    "hyped", "cant wait", "can't wait", "finally", "omg", "exciting",
    "peak", "fire", "go hard", "hard", "badass", "savage", "beast",
    "awesome", "cool", "lit", "amazing", "dope", "goat", "greatest",
]
CONTEXT = [
    "scene", "part", "character", "quote", "quotes", "moment", "moments",
    "reference", "easter egg", "callback", "throwback",
    "trailer", "teaser", "preview", "clip", "ending", "beginning",
]
NEGATIVE = [
    "disappointing", "letdown", "waste", "terrible movie", "awful movie",
    "bad acting", "poor effects", "boring", "lame", "skip", "not watching",
    "wont watch", "wont see", "cash grab", "money grab", "sells out", "sellout",
    "ruin", "ruined", "disaster", "flop", "awful", "horrible",
    "terrible", "worst movie", "garbage", "trash", "pathetic", "embarrassing",
]
EXCITEMENT = [
    "can'?t wait",
    "so excited",
    "(looking|excited) (forward to|for)",
    "(gonna|going to) (be|watch)",
    "hyped",
    "this looks (good|great|amazing)",
    "🔥+",
]
SLANG_WORDS = ["fire", "lit", "peak", "dope", "go(es|ing)? hard", "goat", "W", "banger"]
SLANG_EMOJI = "🔥"
CHEERING_EMOJI = "(🔥|❤️|😍|👍){2,}"

# Theme terms and display names, in the order that breaks ties.
THEMES = {
    "anticipation": [
        "cant wait", "can't wait", "looking forward", "excited", "hyped",
        "excited for", "hype", "finally", "hope", "please", "imagine",
        "gonna be", "going to be", "will be", "should be", "want to see",
    ],
    "visuals": [
        "looks", "animation", "effects", "graphics", "cgi", "beautiful",
        "stunning", "gorgeous", "ugly", "realistic", "detailed", "style",
        "visuals", "visual", "design", "cinematography", "shots", "camera",
    ],
    "characters": [
        "actor", "actress", "character", "protagonist", "villain",
        "cast", "casting", "role", "voice", "voices", "performances",
        "played by", "star", "stars", "starring", "acting", "portrayal",
    ],
    "comparison": [
        "better than", "worse than", "reminds me", "similar to", "like the",
        "just like", "compared to", "copy", "ripoff", "inspired by",
        "original", "sequel", "prequel", "franchise", "universe", "series",
    ],
    "story": [
        "story", "plot", "writing", "narrative", "ending", "beginning",
        "twist", "surprise", "predictable", "cliche", "classic", "arc",
        "character development", "script", "screenplay", "adaptation",
    ],
    "emotion": [
        "love", "hate", "amazing", "awesome", "terrible", "awful",
        "best", "worst", "glad", "sad", "laugh", "cry", "emotional",
        "hilarious", "epic", "shocking", "touching", "boring", "excited",
    ],
    "criticism": [
        "disappointed", "disappointing", "bad", "terrible", "awful",
        "worst", "waste", "trash", "garbage", "hate", "stupid",
        "boring", "problem", "issue", "wrong", "mistake", "missed",
        "ruined", "ruin", "destroyed", "cash grab", "flop", "fail",
    ],
    "marketing": [
        "trailer", "promotion", "ad", "advertisement", "marketing",
        "poster", "teaser", "preview", "reveal", "announced", "release date",
        "premiere", "theater", "theatre", "tickets", "box office",
    ],
    "sound": [
        "music", "soundtrack", "score", "sound", "song", "theme",
        "audio", "composer", "track", "beat", "tune", "sound effects",
    ],
    "production": [
        "director", "producer", "writer", "studio", "budget",
        "production", "release", "delayed", "postponed", "filming",
        "behind the scenes", "making of", "crew", "development",
    ],
}
THEME_NAMES = {
    "anticipation": "Anticipation & Expectations",
    "visuals": "Visual Effects & Cinematography",
    "characters": "Character & Acting Comments",
    "comparison": "Comparisons to Other Media",
    "story": "Story & Plot Discussion",
    "emotion": "Emotional Reactions",
    "criticism": "Critical Comments",
    "marketing": "Marketing & Promotion",
    "sound": "Music & Sound Design",
    "production": "Production & Direction",
}

# Contraction rules: (pattern, replacement) on lower-cased text, applied in order.
CONTRACTIONS = [
    ("’", "'"),
    (r"\bcan't\b", "cannot"),
    (r"\bwon't\b", "will not"),
    (r"\bshan't\b", "shall not"),
    (r"\bain't\b", "are not"),
    (r"\blet's\b", "let us"),
    (r"\by'all\b", "you all"),
    (r"n't\b", " not"),
    (r"'re\b", " are"),
    (r"'m\b", " am"),
    (r"'ll\b", " will"),
    (r"'ve\b", " have"),
    (r"'d\b", " would"),
    (r"\bhe's\b", "he is"),
    (r"\bshe's\b", "she is"),
    (r"\bit's\b", "it is"),
    (r"\bthat's\b", "that is"),
    (r"\bthis's\b", "this is"),
    (r"\bthere's\b", "there is"),
    (r"\bhere's\b", "here is"),
    (r"\bwhat's\b", "what is"),
    (r"\bwhere's\b", "where is"),
    (r"\bwho's\b", "who is"),
    (r"\bhow's\b", "how is"),
    (r"\bgonna\b", "going to"),
    (r"\bgotta\b", "got to"),
    (r"\bwanna\b", "want to"),
]

# A small general opinion lexicon: word -> (polarity, subjectivity). Pass a larger one as an argument.
# Our own scale: strong, clear and mild opinions. Subjectivity grows with the strength.
STRENGTHS = {
    0.9: "awesome best brilliant excellent fantastic perfect stunning wonderful amazing hilarious",
    0.6: "good great beautiful excited exciting glad happy love loved favorite epic",
    0.3: "better fun funny interesting nice cool fresh",
    -0.3: "dark weak crazy scary poor wrong",
    -0.6: "bad worse boring lame sad ugly disappointing disappointed annoying embarrassing stupid",
    -0.9: "worst awful terrible horrible hate hated pathetic evil sick insane brutal",
}
OPINIONS = {word: (p, abs(p)) for p, words in STRENGTHS.items() for word in words.split()}
INTENSIFIERS = {
    "very": 1.3, "really": 1.3, "so": 1.3, "extremely": 1.5, "absolutely": 1.4, "too": 1.2,
    "totally": 1.3, "incredibly": 1.5, "quite": 1.1, "slightly": 0.6, "somewhat": 0.7, "pretty": 1.1,
}
NEGATORS = ["no", "not", "never"]
