"""Tables of domain terms: what counts as a term of history, science, psychology, or of any text."""

from __future__ import annotations

from typing import NamedTuple


class TermPattern(NamedTuple):
    """A kind of term. heads: literals with which every match begins; anchors: literals of which every match has
    one somewhere. Both only speed the search up; a pattern may have neither."""

    pattern: str
    domain: str
    category: str
    confidence: float = 1.0
    heads: tuple[str, ...] = ()
    anchors: tuple[str, ...] = ()


def _alternatives(*words: str) -> str:
    return "|".join(words)


# Words, patterns and confidences, in their order.
WARS = ("World War", "Civil War", "Revolutionary War", "Cold War")
PERIODS = ("Renaissance", "Enlightenment", "Industrial Revolution", "Dark Ages", "Middle Ages", "Bronze Age", "Iron Age", "Stone Age", "Victorian Era", "Gilded Age")
TREATIES = ("Treaty of", "Pact of", "Agreement of", "Convention of", "Accord of")
EVENTS = ("Battle of", "Siege of", "Massacre of", "Revolution of")
LAWS = ("Newton's", "Einstein's", "Boyle's", "Charles'", "Ohm's", "Kepler's", "Mendel's", "Darwin's")
PROCESSES = ("photosynthesis", "mitosis", "meiosis", "osmosis", "diffusion", "respiration", "fermentation", "oxidation", "reduction", "evaporation", "condensation", "sublimation")
PARTICLES = ("electron", "proton", "neutron", "photon", "quark", "neutrino", "atom", "molecule", "ion", "isotope", "nucleus")
ELEMENTS = ("hydrogen", "helium", "lithium", "carbon", "nitrogen", "oxygen", "sodium", "potassium", "calcium", "iron", "copper", "zinc", "gold", "silver", "uranium", "plutonium")
UNITS = ("meters?", "kilometres?", "kilometers?", "grams?", "kilograms?", "liters?", "litres?", "seconds?", "hertz", "joules?", "watts?", "volts?", "amperes?", "ohms?")
THEORISTS = ("Freud's", "Jung's", "Piaget's", "Maslow's", "Skinner's", "Pavlov's", "Erikson's", "Bandura's")
CONCEPTS = ("cognitive dissonance", "classical conditioning", "operant conditioning", "confirmation bias", "hindsight bias", "placebo effect", "halo effect", "Stockholm syndrome", "Dunning-Kruger effect", "impostor syndrome")
DISORDERS = ("depression", "anxiety", "PTSD", "bipolar disorder", "schizophrenia", "OCD", "ADHD", "autism spectrum", "personality disorder")
ANATOMY = ("hippocampus", "amygdala", "prefrontal cortex", "cerebellum", "hypothalamus", "thalamus", "brain stem", "temporal lobe", "frontal lobe", "parietal lobe", "occipital lobe")
TABLE = (
    TermPattern(rf"\b(?:{_alternatives(*WARS)})(?:\s+[IV]+|\s+\d+)?\b", "history", "war", 1.0, WARS),
    TermPattern(rf"\b(?:{_alternatives(*PERIODS)})\b", "history", "period", 0.95, PERIODS),
    TermPattern(rf"\b(?:{_alternatives(*TREATIES)})\s+[A-Z][a-z]+\b", "history", "treaty", 0.9, TREATIES),
    TermPattern(rf"\b(?:{_alternatives(*EVENTS)})\s+[A-Z][a-z]+\b", "history", "event", 0.9, EVENTS),
    TermPattern(r"\b\d{1,2}(?:st|nd|rd|th)\s+century\b", "history", "time", 0.85, (), ("century",)),
    TermPattern(rf"\b(?:{_alternatives(*LAWS)})\s+(?:Law|Laws|Theory|Principle)\b", "science", "law", 1.0, LAWS),
    TermPattern(rf"\b(?:{_alternatives(*PROCESSES)})\b", "science", "process", 0.95, PROCESSES),
    TermPattern(rf"\b(?:{_alternatives(*PARTICLES)})\b", "science", "particle", 0.9, PARTICLES),
    TermPattern(rf"\b(?:{_alternatives(*ELEMENTS)})\b", "science", "element", 0.85, ELEMENTS),
    TermPattern(rf"\b\d+(?:\.\d+)?\s*(?:{_alternatives(*UNITS)})\b", "science", "measurement", 0.8, (), tuple(u.removesuffix("s?") for u in UNITS)),
    TermPattern(rf"\b(?:{_alternatives(*THEORISTS)})\s+(?:Theory|Hierarchy|Model|Stages|Experiment)\b", "psychology", "theory", 1.0, THEORISTS),
    TermPattern(rf"\b(?:{_alternatives(*CONCEPTS)})\b", "psychology", "concept", 0.95, CONCEPTS),
    TermPattern(rf"\b(?:{_alternatives(*DISORDERS)})\b", "psychology", "disorder", 0.9, DISORDERS),
    TermPattern(rf"\b(?:{_alternatives(*ANATOMY)})\b", "psychology", "anatomy", 0.85, ANATOMY),
    TermPattern(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s+(?:is|refers to|means|denotes|signifies)\s+", "general", "definition", 0.8),
    TermPattern(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3}\b", "general", "proper_noun", 0.6),
)
#: Domains that can be told from a text, ties going to the first.
TOLD = ("history", "science", "psychology")
