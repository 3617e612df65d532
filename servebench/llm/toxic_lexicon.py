"""Fixed word classes of the toxicity grammar (fixed values, plain text)."""

# Insults that need no learning; others are learned from the labelled rows.
INSULTS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "clown", "pathetic", "worthless", "disgusting",
           "dumb", "imbecile", "jerk", "bastard", "bitch", "asshole", "retard", "vermin", "subhuman", "filth")

# Phrases of intent; the words must follow one another in a clause.
THREATS = ("kill you", "kill them", "kill him", "kill her", "hurt you", "beat you", "burn you", "destroy you",
           "shoot you", "hang you", "find you", "hunt you", "make you pay", "you will die", "deserve to die",
           "you are dead", "watch your back")

TARGETS = ("you", "your", "he", "she", "him", "they", "them", "these", "those",
           "du", "dich", "ihr", "euch", "tu", "toi", "vous", "vosotros", "ustedes", "usted")

NEGATIONS = ("not", "never", "nobody", "isn", "aren", "wasn", "don", "doesn", "didn", "cannot", "without",
             "nicht", "kein", "keine", "niemals", "pas", "jamais", "nunca", "tampoco")

# Verbs and nouns that hand a clause on to somebody else.
REPORTS = ("said", "says", "called", "calls", "quoted", "wrote", "reported", "claimed", "accused", "allegedly",
           "sagte", "nannte", "schrieb", "disait", "appelait", "dijo", "llamó")
