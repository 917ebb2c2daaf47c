"""Pure Column expressions: text normalisation, scoring, identifiers, HTML regexes."""
