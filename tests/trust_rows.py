"""Small record sets whose splits, matches and digests are known."""

LINEAGE = ("ingest", "1.0.0", "ffb1851efb22f120dcbcc6dc749fa97cf083f11c44aa9e0e0f936f2098005bde", "97e01ae6298d719871b6f20656cd0fd343ddaab6698110be9162e18d2757aca4")

# sample, source, revision, split; source, problem and template family; problem; messages; reference, response; quality; strata
CANDIDATES = [
    ("train:000", "synthetic/train-a", "1111111111111111111111111111111111111111", "UNASSIGNED", ("sf:exact-linked", "pf:exact-copy", "tf:arithmetic-00"), "Find all integers n such that n squared plus three equals nineteen.", [("user", "Find all integers n such that n squared plus three equals nineteen.")], "-4, 4", "The verified derivation isolates the two integer roots.", {"answer_verified": True, "format_valid": True}, {"answer_type": "finite-set", "difficulty": "synthetic"}),
    ("train:001", "synthetic/train-a", "1111111111111111111111111111111111111111", "UNASSIGNED", ("sf:exact-linked", "pf:safe-relative-01", "tf:geometry-01"), "A regular hexagon has side length seven; determine its perimeter.", [("user", "A regular hexagon has side length seven; determine its perimeter.")], "42", "Six equal sides give the requested perimeter.", {"answer_verified": True, "format_valid": True}, {"answer_type": "integer", "difficulty": "synthetic"}),
    ("train:002", "synthetic/train-a", "1111111111111111111111111111111111111111", "UNASSIGNED", ("sf:fuzzy-02", "pf:fuzzy-linked", "tf:commerce-02"), "A merchant has forty red boxes and twenty blue boxes; compute the total number of boxes.", [("user", "A merchant has forty red boxes and twenty blue boxes; compute the total number of boxes.")], "60", "Adding the two inventory categories gives sixty boxes.", {"answer_verified": True, "format_valid": True}, {"answer_type": "integer", "difficulty": "synthetic"}),
    ("train:003", "synthetic/train-b", "2222222222222222222222222222222222222222", "UNASSIGNED", ("sf:safe-03", "pf:fuzzy-linked", "tf:fuzzy-bridge"), "Determine the area of a right triangle with legs nine and twelve.", [("user", "Determine the area of a right triangle with legs nine and twelve.")], "54", "One half of the product of the legs is fifty-four.", {"answer_verified": True, "format_valid": True}, {"answer_type": "integer", "difficulty": "synthetic"}),
    ("train:004", "synthetic/train-b", "2222222222222222222222222222222222222222", "UNASSIGNED", ("sf:safe-04", "pf:safe-04", "tf:fuzzy-bridge"), "Compute the median of the five values three, eight, eleven, fourteen, and twenty.", [("user", "Compute the median of the five values three, eight, eleven, fourteen, and twenty.")], "11", "The ordered middle value is eleven.", {"answer_verified": True, "format_valid": True}, {"answer_type": "integer", "difficulty": "synthetic"}),
    ("train:005", "synthetic/train-b", "2222222222222222222222222222222222222222", "UNASSIGNED", ("sf:trace-copy-05", "pf:trace-copy-05", "tf:inequality-05"), "Explain how the arithmetic mean bounds a product in a generic example.", [("user", "Explain how the arithmetic mean bounds a product in a generic example.")], "illustration", "Archived exercise: Let positive integers a and b satisfy a plus b equals thirty; determine their maximum product. The copied solution follows.", {"answer_verified": True, "format_valid": True}, {"answer_type": "explanation", "difficulty": "synthetic"}),
    ("train:006", "synthetic/train-a", "1111111111111111111111111111111111111111", "UNASSIGNED", ("sf:safe-06", "pf:safe-06", "tf:probability-06"), "A fair coin is tossed four times; compute the probability of exactly one head.", [("user", "A fair coin is tossed four times; compute the probability of exactly one head.")], "1/4", "There are four favorable strings among sixteen equally likely strings.", {"answer_verified": True, "format_valid": True}, {"answer_type": "rational", "difficulty": "synthetic"}),
    ("train:007", "synthetic/train-b", "2222222222222222222222222222222222222222", "UNASSIGNED", ("sf:safe-07", "pf:safe-07", "tf:algebra-07"), "Solve the linear equation seven x minus five equals thirty-seven.", [("user", "Solve the linear equation seven x minus five equals thirty-seven.")], "6", "Adding five and dividing by seven yields six.", {"answer_verified": True, "format_valid": True}, {"answer_type": "integer", "difficulty": "synthetic"}),
    ("train:008", "synthetic/train-a", "1111111111111111111111111111111111111111", "UNASSIGNED", ("sf:safe-08", "pf:safe-08", "tf:number-theory-08"), "Find the greatest common divisor of one hundred forty-four and ninety-six.", [("user", "Find the greatest common divisor of one hundred forty-four and ninety-six.")], "48", "The Euclidean algorithm terminates at forty-eight.", {"answer_verified": True, "format_valid": True}, {"answer_type": "integer", "difficulty": "synthetic"}),
    ("train:009", "synthetic/train-b", "2222222222222222222222222222222222222222", "UNASSIGNED", ("sf:safe-09", "pf:safe-09", "tf:sequence-09"), "An arithmetic sequence begins at five with common difference four; find its tenth term.", [("user", "An arithmetic sequence begins at five with common difference four; find its tenth term.")], "41", "Nine increments of four added to five produce forty-one.", {"answer_verified": True, "format_valid": True}, {"answer_type": "integer", "difficulty": "synthetic"}),
    ("train:010", "synthetic/train-a", "1111111111111111111111111111111111111111", "UNASSIGNED", ("sf:safe-10", "pf:safe-10", "tf:calculus-10"), "Differentiate the polynomial three x cubed minus two x plus seven.", [("user", "Differentiate the polynomial three x cubed minus two x plus seven.")], "9x^2-2", "Apply the power rule term by term.", {"answer_verified": True, "format_valid": True}, {"answer_type": "expression", "difficulty": "synthetic"}),
    ("train:011", "synthetic/train-b", "2222222222222222222222222222222222222222", "UNASSIGNED", ("sf:safe-11", "pf:safe-11", "tf:combinatorics-11"), "Count the ways to choose three books from a shelf containing eight distinct books.", [("user", "Count the ways to choose three books from a shelf containing eight distinct books.")], "56", "The binomial coefficient eight choose three equals fifty-six.", {"answer_verified": True, "format_valid": True}, {"answer_type": "integer", "difficulty": "synthetic"}),
    ("train:012", "synthetic/train-a", "1111111111111111111111111111111111111111", "UNASSIGNED", ("sf:safe-12", "pf:safe-12", "tf:geometry-12"), "A circle has radius thirteen; express its circumference in terms of pi.", [("user", "A circle has radius thirteen; express its circumference in terms of pi.")], "26pi", "Twice pi times the radius gives twenty-six pi.", {"answer_verified": True, "format_valid": True}, {"answer_type": "expression", "difficulty": "synthetic"}),
    ("train:013", "synthetic/train-b", "2222222222222222222222222222222222222222", "UNASSIGNED", ("sf:safe-13", "pf:safe-13", "tf:statistics-13"), "Compute the mean of the four observations two, six, ten, and fourteen.", [("user", "Compute the mean of the four observations two, six, ten, and fourteen.")], "8", "Their sum is thirty-two and division by four gives eight.", {"answer_verified": True, "format_valid": True}, {"answer_type": "integer", "difficulty": "synthetic"}),
    ("train:014", "synthetic/train-a", "1111111111111111111111111111111111111111", "UNASSIGNED", ("sf:safe-14", "pf:safe-14", "tf:logic-14"), "Negate the statement that every synthetic vertex has even degree.", [("user", "Negate the statement that every synthetic vertex has even degree.")], "Some vertex has odd degree.", "Replace the universal quantifier by an existential counterexample.", {"answer_verified": True, "format_valid": True}, {"answer_type": "statement", "difficulty": "synthetic"}),
]

# sample, source, revision, split; source, problem and template family; problem; messages; reference, response; quality; strata
HELD = [
    ('eval:000', 'synthetic/eval', '3333333333333333333333333333333333333333', 'E', ('sf:eval-00', 'pf:eval-00', 'tf:eval-00'), 'FIND ALL INTEGERS N SUCH THAT N SQUARED PLUS THREE EQUALS NINETEEN.', [('user', 'FIND ALL INTEGERS N SUCH THAT N SQUARED PLUS THREE EQUALS NINETEEN.')], '-4, 4', None, {'answer_verified': True, 'format_valid': True}, {'answer_type': 'finite-set', 'difficulty': 'synthetic'}),
    ('eval:001', 'synthetic/eval', '3333333333333333333333333333333333333333', 'E', ('sf:eval-01', 'pf:eval-01', 'tf:eval-01'), 'A merchant has forty red boxes and twenty blue boxes. Compute the total number of boxes.', [('user', 'A merchant has forty red boxes and twenty blue boxes. Compute the total number of boxes.')], '60', None, {'answer_verified': True, 'format_valid': True}, {'answer_type': 'integer', 'difficulty': 'synthetic'}),
    ('eval:002', 'synthetic/eval', '3333333333333333333333333333333333333333', 'E', ('sf:eval-02', 'pf:eval-02', 'tf:eval-02'), 'Let positive integers a and b satisfy a plus b equals thirty; determine their maximum product.', [('user', 'Let positive integers a and b satisfy a plus b equals thirty; determine their maximum product.')], '225', None, {'answer_verified': True, 'format_valid': True}, {'answer_type': 'integer', 'difficulty': 'synthetic'}),
    ('eval:003', 'synthetic/eval', '3333333333333333333333333333333333333333', 'E', ('sf:eval-03', 'pf:eval-03', 'tf:eval-03'), 'Prove that a connected acyclic graph on twelve vertices contains exactly eleven edges.', [('user', 'Prove that a connected acyclic graph on twelve vertices contains exactly eleven edges.')], 'Induction on the number of vertices.', None, {'answer_verified': True, 'format_valid': True}, {'answer_type': 'proof', 'difficulty': 'synthetic'}),
]
