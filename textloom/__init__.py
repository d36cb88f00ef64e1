"""textloom: full-text search and text analytics on Spark DataFrames."""

from textloom.functions.analyzer import Analyzer, TokenStream, standard_analyzer
from textloom.functions.filters import LowercaseFilter, StemmerFilter, StopWordFilter
from textloom.functions.highlight import HighlightOptions
from textloom.functions.hmm import HmmModel
from textloom.functions.scoring import BM25
from textloom.functions.tokenizers import DictionaryTokenizer, HmmTokenizer, SimpleTokenizer, StandardTokenizer, WhitespaceTokenizer
from textloom.operators.search_index import IndexConfig, SearchIndex, add, new_index
from textloom.plans.ast import BooleanQuery, FuzzyQuery, MatchQuery, PhraseQuery, PrefixQuery, TermQuery
from textloom.plans.parser import parse
from textloom.sources.store import KeyValueStore, StoredIndex

__version__ = "0.1.0"

__all__ = [
    "Analyzer", "BM25", "BooleanQuery", "DictionaryTokenizer", "FuzzyQuery", "HighlightOptions", "HmmModel", "HmmTokenizer", "IndexConfig", "KeyValueStore",
    "LowercaseFilter", "MatchQuery", "PhraseQuery", "PrefixQuery", "SearchIndex", "SimpleTokenizer", "StandardTokenizer", "StemmerFilter", "StopWordFilter",
    "StoredIndex", "TermQuery", "TokenStream", "WhitespaceTokenizer", "add", "new_index", "parse", "standard_analyzer",
]
