"""Training-data operators (language id, de-duplication, decontamination,
fingerprints, language-model scoring, tokens, sharding, quality).  Nothing
else in the library imports this subpackage."""
