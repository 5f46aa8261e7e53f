"""The labelled evaluation corpus and its knowledge bases, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The evaluation's knowledge base, as (subject, predicate, object) in order.
EVALUATION_FACTS = [
    ("Alexander Graham Bell", "invented", "the telephone"),
    ("Thomas Edison", "invented", "the light bulb"),
    ("Thomas Edison", "invented", "the lightbulb"),
    ("Nikola Tesla", "invented", "alternating current"),
    ("Guglielmo Marconi", "invented", "the radio"),
    ("Tim Berners-Lee", "invented", "the World Wide Web"),
    ("Leonardo da Vinci", "painted", "the Mona Lisa"),
    ("Albert Einstein", "discovered", "the theory of relativity"),
    ("Marie Curie", "discovered", "radium"),
    ("Marie Curie", "discovered", "polonium"),
    ("Isaac Newton", "discovered", "gravity"),
    ("Isaac Newton", "found", "gravity"),
    ("Charles Darwin", "proposed", "the theory of evolution"),
    ("Bill Gates", "founded", "Microsoft"),
    ("Steve Jobs", "co-founded", "Apple"),
    ("Steve Jobs", "founded", "Apple"),
    ("Mark Zuckerberg", "founded", "Facebook"),
    ("Guido van Rossum", "created", "Python"),
    ("Linus Torvalds", "created", "Linux"),
    ("The Eiffel Tower", "located_in", "Paris"),
    ("The Great Wall", "located_in", "China"),
    ("The Statue of Liberty", "located_in", "New York"),
    ("The Colosseum", "located_in", "Rome"),
    ("Mount Everest", "is", "the tallest mountain"),
    ("Tokyo", "capital_of", "Japan"),
    ("Paris", "capital_of", "France"),
    ("Berlin", "capital_of", "Germany"),
    ("Albert Einstein", "born_in", "Germany"),
    ("Isaac Newton", "born_in", "England"),
    ("George Washington", "was", "the first US president"),
    ("Shakespeare", "wrote", "Hamlet"),
    ("Water", "composed_of", "hydrogen and oxygen"),
    ("The moon", "orbits", "the Earth"),
    ("Beethoven", "composed", "the 9th Symphony"),
]

# The labelled claims by set; T true fact, A false attribution, C contradiction, F fabrication.
CASES = {
    "false_attribution": [
        ("Alexander Graham Bell invented the telephone.", "T"), ("Thomas Edison invented the telephone.", "A"),
        ("Thomas Edison invented the light bulb.", "T"), ("Nikola Tesla invented the light bulb.", "A"),
        ("Guglielmo Marconi invented the radio.", "T"), ("Thomas Edison invented the radio.", "A"),
        ("Albert Einstein discovered the theory of relativity.", "T"), ("Isaac Newton discovered the theory of relativity.", "A"),
        ("Marie Curie discovered radium.", "T"), ("Nikola Tesla discovered radium.", "A"),
        ("Isaac Newton discovered gravity.", "T"), ("Galileo discovered gravity.", "A"),
        ("Bill Gates founded Microsoft.", "T"), ("Steve Jobs founded Microsoft.", "A"),
        ("Mark Zuckerberg founded Facebook.", "T"), ("Elon Musk founded Facebook.", "A"),
    ],
    "contradictions": [
        ("Albert Einstein was born in Germany.", "T"), ("Albert Einstein was born in France.", "C"),
        ("Isaac Newton was born in England.", "T"), ("Isaac Newton was born in Italy.", "C"),
        ("The Eiffel Tower is located in Paris.", "T"), ("The Eiffel Tower is located in London.", "C"),
        ("The Statue of Liberty is located in New York.", "T"), ("The Statue of Liberty is located in Boston.", "C"),
        ("The Colosseum is located in Rome.", "T"), ("The Colosseum is located in Athens.", "C"),
        ("Tokyo is the capital of Japan.", "T"), ("Tokyo is the capital of China.", "C"),
        ("Paris is the capital of France.", "T"), ("Paris is the capital of Spain.", "C"),
        ("Berlin is the capital of Germany.", "T"), ("Berlin is the capital of Austria.", "C"),
    ],
    "fabrications": [
        ("Python was created by Guido van Rossum.", "T"), ("Einstein invented the internet.", "F"),
        ("Tim Berners-Lee invented the World Wide Web.", "T"), ("Albert Einstein invented the computer.", "F"),
        ("Marie Curie discovered radium.", "T"), ("Marie Curie invented the smartphone.", "F"),
        ("The Great Wall is located in China.", "T"), ("The Great Wall was built by Napoleon.", "F"),
        ("Shakespeare wrote Hamlet.", "T"), ("Shakespeare invented the printing press.", "F"),
        ("Water is composed of hydrogen and oxygen.", "T"), ("Isaac Newton invented time travel.", "F"),
        ("The moon orbits the Earth.", "T"), ("Julius Caesar discovered Antarctica.", "F"),
        ("Leonardo da Vinci painted the Mona Lisa.", "T"), ("Leonardo da Vinci invented the airplane.", "F"),
    ],
    "edge_cases": [
        ("Bell invented telephone.", "T"), ("Einstein relativity.", "T"),
        ("Edison created the lightbulb.", "T"), ("Newton found gravity.", "T"),
        ("Thomas Edison discovered electricity.", "F"), ("Marie Curie invented polonium.", "A"),
        ("Einstein did not discover gravity.", "T"), ("Bell did not invent the computer.", "T"),
    ],
    "domains": [
        ("Darwin proposed the theory of evolution.", "T"), ("Lamarck proposed the theory of evolution.", "A"),
        ("Steve Jobs co-founded Apple.", "T"), ("Bill Gates co-founded Apple.", "A"),
        ("George Washington was the first US president.", "T"), ("Abraham Lincoln was the first US president.", "A"),
        ("Mount Everest is the tallest mountain.", "T"), ("K2 is the tallest mountain.", "C"),
        ("Beethoven composed the 9th Symphony.", "T"), ("Mozart composed the 9th Symphony.", "A"),
    ],
}
TYPES = {"T": "true_fact", "A": "false_attr", "C": "contradiction", "F": "fabrication"}

# The memory algorithm's knowledge base, as (subject, predicate, object) in order.
MEMORY_FACTS = [
    ("Alexander Graham Bell", "invented", "the telephone"),
    ("Thomas Edison", "invented", "the light bulb"),
    ("Guglielmo Marconi", "invented", "the radio"),
    ("Albert Einstein", "discovered", "the theory of relativity"),
    ("Marie Curie", "discovered", "radium"),
    ("Isaac Newton", "discovered", "gravity"),
    ("Charles Darwin", "proposed", "the theory of evolution"),
    ("The Eiffel Tower", "located_in", "Paris"),
    ("The Great Wall", "located_in", "China"),
    ("The Statue of Liberty", "located_in", "New York"),
    ("The Colosseum", "located_in", "Rome"),
    ("Tokyo", "capital_of", "Japan"),
    ("Paris", "capital_of", "France"),
    ("Berlin", "capital_of", "Germany"),
    ("Albert Einstein", "born_in", "Germany"),
    ("Isaac Newton", "born_in", "England"),
    ("Bill Gates", "founded", "Microsoft"),
    ("Steve Jobs", "founded", "Apple"),
    ("Mark Zuckerberg", "founded", "Facebook"),
    ("Guido van Rossum", "created", "Python"),
    ("George Washington", "was", "the first US president"),
    ("Shakespeare", "wrote", "Hamlet"),
    ("Beethoven", "composed", "the 9th Symphony"),
]


def memory_facts(spark: SparkSession) -> DataFrame:
    """fact_seq, subject, predicate, object of the memory algorithm."""
    return spark.createDataFrame([(k, *f) for k, f in enumerate(MEMORY_FACTS)], "fact_seq long, subject string, predicate string, object string")


def evaluation_facts(spark: SparkSession) -> DataFrame:
    """fact_seq, subject, predicate, object."""
    return spark.createDataFrame([(k, *f) for k, f in enumerate(EVALUATION_FACTS)], "fact_seq long, subject string, predicate string, object string")


def case_rows() -> list[tuple]:
    out = []
    for name, cases in CASES.items():
        out += [(len(out) + k, name, k, claim, kind == "T", TYPES[kind]) for k, (claim, kind) in enumerate(cases)]
    return out


def cases(spark: SparkSession) -> DataFrame:
    """case_id, set_key, case_idx, text, is_true, h_type."""
    return spark.createDataFrame(case_rows(), "case_id long, set_key string, case_idx int, text string, is_true boolean, h_type string")
