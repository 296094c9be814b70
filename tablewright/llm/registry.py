"""The queries of this subpackage, and their SQL where SQL can express them."""

from .brown import op4_brown
from .decontaminate import OP1_SQL, op1_decontamination
from .exact_dedup import OP8_SQL, op8_exact_dedup
from .fixity import OP2_SQL, op2_fixity
from .langid import op5_langid
from .lines import op7_line_dedup
from .mixing import OP9_SQL, op9_mixing
from .quality import op10_quality
from .secrets import op3_secrets
from .simhash import op6_simhash

QUERIES = {
    "op4_brown": op4_brown,
    "op7_line_dedup": op7_line_dedup,
    "op2_fixity": op2_fixity,
    "op3_secrets": op3_secrets,
    "op5_langid": op5_langid,
    "op10_quality": op10_quality,
    "op1_decontamination": op1_decontamination,
    "op6_simhash": op6_simhash,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_mixing": op9_mixing,
}
ORACLES = {"op2_fixity": OP2_SQL, "op1_decontamination": OP1_SQL, "op8_exact_dedup": OP8_SQL, "op9_mixing": OP9_SQL}
